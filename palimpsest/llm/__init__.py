"""Operators that prepare language-model training data, one module each."""
