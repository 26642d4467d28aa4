"""A reference of a numeric column and each value's position in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import percentiles

DISCRETE, ATOM, BINS = 100, 0.01, 100


def reference(rows: DataFrame, column: str) -> DataFrame:
    """(low, high, share): the distribution of a column's present values in a few hundred rows at most.

    Up to DISCRETE values stand by themselves (low = high). Else values that hold at least ATOM of the rows do, and the
    others form bins [low, high) between their percentiles, the last one closed.
    """
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    size = counts.agg(F.count("*").alias("distinct"), F.sum("n").alias("all")).first()
    if not size["distinct"]:
        return counts.select(F.col("v").alias("low"), F.col("v").alias("high"), F.lit(0.0).alias("share"))
    alone = counts if size["distinct"] <= DISCRETE else counts.filter(F.col("n") >= ATOM * size["all"])
    masses = alone.select(F.col("v").alias("low"), F.col("v").alias("high"), (F.col("n") / size["all"]).alias("share"))
    if size["distinct"] <= DISCRETE:
        return masses
    rest = counts.filter(F.col("n") < ATOM * size["all"])
    found = percentiles(rest, [], "v", [i / BINS for i in range(BINS + 1)], F.col("n")).first()
    edges = sorted({e for e in found or [] if e is not None})
    if len(edges) < 2:
        return masses
    ends = F.array(*map(F.lit, edges))
    at = F.least(F.size(F.filter(ends, lambda e: e <= F.col("v"))), F.lit(len(edges) - 1))
    bins = rest.groupBy(at.alias("at")).agg((F.sum("n") / size["all"]).alias("share"))
    return masses.unionByName(bins.select(F.element_at(ends, F.col("at")).alias("low"), F.element_at(ends, F.col("at") + 1).alias("high"), "share"))


def position(rows: DataFrame, column: str, known: DataFrame, name: str = "position") -> DataFrame:
    """rows with the share of the reference below each value, half of a mass that it sits on, a bin's share spread evenly;
    0 below the reference, 1 above, null for null. The reference is a few hundred rows, gathered into one array."""
    parts = known.agg(F.collect_list(F.struct("low", "high", "share")).alias("__parts"))  # one row
    x = F.col(column).cast("double")
    below = lambda p: F.when(p["low"] == p["high"], F.when(p["low"] < x, 1.0).when(p["low"] == x, 0.5).otherwise(0.0)).otherwise(F.least(F.greatest((x - p["low"]) / (p["high"] - p["low"]), F.lit(0.0)), F.lit(1.0)))
    total = F.aggregate("__parts", F.lit(0.0), lambda s, p: s + p["share"] * below(p))
    return rows.crossJoin(parts).withColumn(name, F.when(x.isNotNull(), F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))).drop("__parts")  # one row
