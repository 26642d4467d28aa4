"""Palimpsest: a Spark-native analytics engine for versioned record logs."""
