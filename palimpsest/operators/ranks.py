"""Running sums, positions and exact percentiles in a global order, without a task that holds a whole group.

Rows are dealt by ranges of their order and stored by a checkpoint, so that both passes see the same
ranges. Sums per range are carried over from range to range; inside a range a window runs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_folder


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """rows with __range, the number of their range in the order of by and order."""
    shared_folder(rows.sparkSession)
    return rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()).checkpoint()


def with_earlier(held: DataFrame, by: Sequence[str], value: Column, name: str) -> DataFrame:
    """held with the sum of value over the earlier ranges of its group: one row per group and range is carried over."""
    totals = held.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__of"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias(name))
    same = F.col("__range") == F.col("__of")
    for i, c in enumerate(by):
        same = same & held[c].eqNullSafe(F.col(f"__by{i}"))
    return held.join(totals, same).drop("__of", *[f"__by{i}" for i in range(len(by))])


def sum_before(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over the rows of their group that come before them in order; 0 for the first."""
    held = with_earlier(ranged(rows, by, order), by, value, "__earlier")
    inside = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return held.withColumn(name, F.col("__earlier") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("__earlier", "__range")


def positions(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], name: str, total: str) -> DataFrame:
    """rows with their position in their group, from 0, and the group's number of rows."""
    held = sum_before(rows, by, order, F.lit(1), name)
    if not by:
        return held.crossJoin(rows.agg(F.count("*").alias(total)))  # one row
    sizes = rows.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.count("*").alias(total))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & held[c].eqNullSafe(F.col(f"__by{i}"))
    return held.join(sizes, same).drop(*[f"__by{i}" for i in range(len(by))])


def percentiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Sequence[float], times: Column | None = None) -> DataFrame:
    """(by, p0, p1, ...): exact percentiles with linear interpolation, each row counted once or `times`; nulls don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if times is None else F.sum(times)).alias("__n"))
    held = sum_before(counts, by, [value], F.col("__n"), "__before")
    total = held.groupBy(*by).agg(F.sum("__n").alias("__all"))
    held = held.join(total, list(by)) if by else held.crossJoin(total)  # one row
    picked = []
    for i, p in enumerate(fractions):
        at = (F.col("__all") - 1) * F.lit(float(p))
        for side, place in (("l", F.floor(at)), ("h", F.ceil(at))):
            inside = (F.col("__before") <= place) & (place < F.col("__before") + F.col("__n"))
            picked.append(F.max(F.when(inside, F.col(value))).alias(f"__{side}{i}"))
        picked.append(F.max(at - F.floor(at)).alias(f"__w{i}"))
    return held.groupBy(*by).agg(*picked).select(*by, *[(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__w{i}")).alias(f"p{i}") for i in range(len(fractions))])
