"""Serving tables: change-only upserts, score history, rescore scope, search and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(held: DataFrame, batch: DataFrame, keys: Sequence[str], prune: bool = False) -> DataFrame:
    """The table after a batch, with change: kept, updated, inserted (and, if prune, without keys that the batch lacks).

    A row that the batch repeats unchanged is kept as it is; write the result over the table.
    """
    fields = [c for c in held.columns if c not in keys]
    a = held.select(*keys, F.struct(*fields).alias("__a"))
    b = batch.select(*keys, F.struct(*fields).alias("__b"))
    both = a.join(b, list(keys), "right" if prune else "full")
    change = F.when(F.col("__a").isNull(), "inserted").when(F.col("__b").isNull() | (F.col("__a") == F.col("__b")), "kept").otherwise("updated")
    return both.withColumn("__r", F.coalesce("__b", "__a")).withColumn("change", change).select(*keys, "__r.*", "change").select(*held.columns, "change")


def insert_new(held: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a batch whose key the table lacks, each key once."""
    return batch.dropDuplicates(list(keys)).join(held.select(*keys), list(keys), "left_anti")


def history_reasons(previous: DataFrame, scores: DataFrame, least: float = 0.01) -> DataFrame:
    """scores (id, hash, index, model, risk) that enter the history, with the reasons; previous: the last row of each id."""
    p = previous.select("id", *[F.col(c).alias(f"old_{c}") for c in ("hash", "index", "model", "risk")])
    both = scores.join(p, "id", "left")
    named = F.array_compact(F.array(F.when(~F.col("hash").eqNullSafe(F.col("old_hash")), F.lit("record_change")), F.when(F.col("index") > F.col("old_index"), F.lit("landmark_passed")), F.when(F.col("model") != F.col("old_model"), F.lit("new_model"))))
    reasons = F.when(F.col("old_risk").isNull(), F.array(F.lit("first_score"))).when(F.size(named) > 0, named).when(F.abs(F.col("risk") - F.col("old_risk")) >= least, F.array(F.lit("calendar"))).otherwise(F.array().cast("array<string>"))
    return both.withColumn("reasons", reasons).filter(F.size("reasons") > 0).select(*scores.columns, "reasons")


def rescore_scope(scored: DataFrame, now: DataFrame) -> DataFrame:
    """(id, scope): changed where hash, index or model differ, new, or gone."""
    a = scored.select("id", F.struct("hash", "index", "model").alias("a"))
    b = now.select("id", F.struct("hash", "index", "model").alias("b"))
    scope = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "id", "full").select("id", scope.alias("scope")).filter("scope is not null")


def page(rows: DataFrame, order: Sequence, limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_prefix(rows: DataFrame, key: str, prefix: str, limit: int = 50) -> DataFrame:
    return rows.filter(F.col(key).startswith(prefix)).orderBy(key).limit(limit)


def top_drivers(names, values, k: int):
    """The k (name, value) pairs of largest absolute value of two parallel arrays, ties by name."""
    pairs = F.transform(F.arrays_zip(names.alias("n"), values.alias("v")), lambda p: F.struct((-F.abs(p["v"])).alias("by"), p["n"].alias("name"), p["v"].alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value")))


def latest_two(rows: DataFrame, key: str, date: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))).filter("rank <= 2")


def share_of_key(key: str, seed: int, share: float):
    """A condition that draws all rows of a share of keys, by key and seed alone."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))


def stratified_allocation(sizes: DataFrame, stratum: str, n: str, total: int) -> DataFrame:
    """(stratum, take): largest-remainder shares of total; sizes has a row per stratum."""
    quota = sizes.withColumn("q", F.col(n) * total / F.sum(n).over(Window.partitionBy())).withColumn("take", F.floor("q"))
    left = F.lit(total) - F.sum("take").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.col("q") - F.col("take")), stratum))
    return quota.select(stratum, (F.col("take") + F.when(rank <= left, 1).otherwise(0)).alias("take"))
