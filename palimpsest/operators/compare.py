"""Comparing tables, releases and builds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksum(rows: DataFrame) -> DataFrame:
    """(n_rows, checksum): a sum over row hashes, the same for any order of rows."""
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("checksum"))


def column_differences(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(column, n_differ) over keys of both, in one join."""
    shared = [c for c in old.columns if c in new.columns and c not in keys]
    a, b = old.select(*keys, F.struct(*shared).alias("a")), new.select(*keys, F.struct(*shared).alias("b"))
    counts = a.join(b, list(keys)).agg(*[F.count_if(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(c) for c in shared])
    return counts.unpivot([], shared, "column", "n_differ")


def key_overlap(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(presence, n): keys of both, only the old, only the new."""
    a, b = old.select(*keys).distinct().withColumn("__a", F.lit(1)), new.select(*keys).distinct().withColumn("__b", F.lit(1))
    presence = F.when(F.col("__a").isNull(), "only_new").when(F.col("__b").isNull(), "only_old").otherwise("both")
    return a.join(b, list(keys), "full").groupBy(presence.alias("presence")).agg(F.count("*").alias("n"))


def multiset_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one table has; side tells which."""
    new = new.select(old.columns)
    return old.exceptAll(new).withColumn("side", F.lit("old")).unionByName(new.exceptAll(old).withColumn("side", F.lit("new")))


def null_shares(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, share) of nulls, in one pass."""
    columns = list(columns or rows.columns)
    return rows.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).unpivot([], columns, "column", "share")


def combine(pinned: DataFrame, gap: DataFrame, key: str, version: str, date: str) -> DataFrame:
    """Both histories; refuses a gap version at or before the pinned history's last version or date of its entity."""
    last = pinned.groupBy(key).agg(F.max(version).alias("__v"), F.max(date).alias("__d"))
    clash = gap.join(last, key).filter((F.col(version) <= F.col("__v")) | (F.col(date) < F.col("__d"))).limit(1).count()
    if clash:
        raise ValueError("the gap overlaps the pinned history")
    return pinned.unionByName(gap)


def schema_drift(schemas: dict[str, dict[str, str]]) -> dict[str, dict[str, list[str]]]:
    """Columns with several types among files: column to type to files. schemas: file to column to type."""
    found: dict[str, dict[str, list[str]]] = {}
    for file, columns in schemas.items():
        for column, kind in columns.items():
            found.setdefault(column, {}).setdefault(kind, []).append(file)
    return {c: kinds for c, kinds in found.items() if len(kinds) > 1}
