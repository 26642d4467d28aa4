"""Operators on version logs: latest per day, running history, validity, sweeps, quarantine, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_per(versions: DataFrame, by: Sequence[str], version: str) -> DataFrame:
    """The row of the highest version of each group; of equal versions the one of least content hash, whatever the run."""
    hashed = F.xxhash64(*[f.name for f in versions.schema.fields if "map" not in f.dataType.simpleString()])
    rank = Window.partitionBy(*by).orderBy(F.col(version).desc_nulls_last(), hashed)
    return versions.withColumn("__n", F.row_number().over(rank)).filter("__n = 1").drop("__n")


def arg_min(value: Column, order: Column) -> Column:
    """The value at the least order among rows whose value is not null."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def arg_max(value: Column, order: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), order))


def running_history(versions: DataFrame, key: str, order: Sequence[str], first: Sequence[str], ever: Mapping[str, Column]) -> DataFrame:
    """versions with n_versions so far, first_<column> of the history (nulls kept) and whether a condition ever held."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranked = Window.partitionBy(key).orderBy(*order)
    return versions.select(
        "*", F.row_number().over(ranked).alias("n_versions"), *[F.first(c).over(so_far).alias(f"first_{c}") for c in first], *[F.coalesce(F.max(c).over(so_far), F.lit(False)).alias(n) for n, c in ever.items()]
    )


def validity(states: DataFrame, key: str, date: str, until: str = "next_effective") -> DataFrame:
    """States with the date of the next one: each holds in [date, next)."""
    return states.withColumn(until, F.lead(date).over(Window.partitionBy(key).orderBy(date)))


def open_counts(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """(day, n_open): open intervals [start, end) at the end of each day of change; null end stays open.

    Changes are summed per day before the one ordered window, which is as long as the calendar.
    """
    plus = intervals.select(F.col(start).alias("day"), F.lit(1).alias("change"))
    minus = intervals.select(F.col(end).alias("day"), F.lit(-1).alias("change")).filter("day is not null")
    daily = plus.unionByName(minus).groupBy("day").agg(F.sum("change").alias("change"))
    return daily.select("day", F.sum("change").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("n_open"))


def quarantine(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every check, and the others with reasons: the names of failed checks, sorted, '; ' between. An unknown check holds."""
    failed = F.array_sort(F.array_compact(F.array(*[F.when(~c, F.lit(n)) for n, c in checks.items()])))
    judged = rows.withColumn("reasons", F.array_join(failed, "; "))
    return judged.filter("reasons = ''").drop("reasons"), judged.filter("reasons <> ''")


def unique_in(rows: DataFrame, *keys: str) -> Column:
    """Whether no other row has the same key; all rows of a repeated key fail."""
    return F.count("*").over(Window.partitionBy(*keys)) == 1


def out_of_order(versions: DataFrame, key: str, version: str, date: str) -> DataFrame:
    """Versions dated before an earlier version of the same entity."""
    earlier = Window.partitionBy(key).orderBy(version).rowsBetween(Window.unboundedPreceding, -1)
    return versions.withColumn("max_before", F.max(date).over(earlier)).filter(F.col(date) < F.col("max_before"))


def repeats(versions: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Versions equal in all columns to the one before."""
    w = Window.partitionBy(key).orderBy(version)
    same = F.struct(*columns).eqNullSafe(F.lag(F.struct(*columns)).over(w)) & (F.row_number().over(w) > 1)
    return versions.withColumn("__same", same).filter("__same").drop("__same")


def changes(versions: DataFrame, key: str, version: str, columns: Sequence[str]) -> DataFrame:
    """Versions after the first that change any column, with the names of those that changed."""
    w = Window.partitionBy(key).orderBy(version)
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.lag(c).over(w)), F.lit(c)) for c in columns]))
    return versions.withColumn("changed", changed).withColumn("__n", F.row_number().over(w)).filter("__n > 1 and size(changed) > 0").drop("__n")
