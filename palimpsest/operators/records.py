"""Checked joins, guards and nested records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import positions


def guarded(rows: DataFrame, broken: Column, message: str) -> DataFrame:
    """rows as they are; reading a row for which `broken` holds raises an error."""
    first = rows.columns[0]
    refused = F.raise_error(F.lit(message)).cast(rows.schema[first].dataType)
    return rows.withColumn(first, F.when(F.coalesce(broken, F.lit(False)), refused).otherwise(F.col(first)))


def unique_keys(rows: DataFrame, keys: Sequence[str], message: str) -> DataFrame:
    """The distinct keys; a key that occurs twice raises an error when it is read."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    return guarded(counts, F.col("__n") > 1, message).drop("__n")


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full join of two tables with unique keys, with side: both, left_only or right_only. Null keys match no row. A
    repeated key on either side raises an error."""
    sides = [f.join(unique_keys(f.filter(F.coalesce(*[F.col(k).isNotNull() for k in keys])), keys, f"a key occurs twice on the {name}"), list(keys), "left_semi") for f, name in ((left, "left"), (right, "right"))]
    a, b = sides[0].withColumn("__l", F.lit(True)), sides[1].withColumn("__r", F.lit(True))
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    return a.join(b, list(keys), "full").withColumn("side", side).drop("__l", "__r")


def misaligned(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that two tables do not hold equally often: keys, n_left, n_right. Empty if they describe the same rows."""
    each = left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r")))
    return each.groupBy(*keys).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right")).filter("n_left <> n_right")


def mapped_values(rows: DataFrame, names: DataFrame, key: str, value: str) -> DataFrame:
    """rows with the value that names (key, value) give their key; a missing and an empty key are one."""
    shared = names.groupBy(F.coalesce(F.col(key), F.lit("")).alias("__key")).agg(F.first(value, ignorenulls=True).alias(value))
    return rows.withColumn("__key", F.coalesce(F.col(key), F.lit(""))).join(shared, "__key", "left").drop("__key")


def dense_codes(rows: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, code): distinct keys numbered from 0 in their order, nulls left out."""
    return positions(rows.filter(F.col(key).isNotNull()).select(key).distinct(), [], [key], code, "__n").drop("__n")


def value_years(rows: DataFrame, day: str, columns: Sequence[str], quarantined: DataFrame | None = None) -> DataFrame:
    """(column, value, n, first_year, last_year) of the values of columns, in rows and in those set aside."""
    every = rows if quarantined is None else rows.unionByName(quarantined, allowMissingColumns=True)
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    each = every.select(F.year(day).alias("year"), pairs)
    return each.groupBy("column", "value").agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def without_column_digest(rows: DataFrame, *left_out: str) -> DataFrame:
    """(n_rows, digest): rows as JSON without some columns, hashed, whatever their order."""
    kept = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in left_out]), {"ignoreNullFields": "false"}), 256)
    half = F.conv(F.substring(kept, 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n_rows"), F.sum(half).alias("digest"))


def named_kinds(items: Column) -> Column:
    """The kind of each distinct (name, kind) pair of an array of structs, sorted; pairs without either left out."""
    whole = F.filter(items, lambda x: x["kind"].isNotNull() & x["name"].isNotNull() & (x["name"] != ""))
    return F.array_sort(F.transform(F.array_distinct(whole), lambda x: x["kind"]))


def presence(rows: DataFrame, fields: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """(field, applicable, present, share): fields maps a name to (value, whether it applies to the row)."""
    sums = rows.agg(*[F.struct(F.lit(n).alias("field"), F.count_if(when).alias("applicable"), F.count_if(when & value.isNotNull()).alias("present")).alias(f"f{i}") for i, (n, (value, when)) in enumerate(fields.items())])
    each = sums.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(fields))])))
    return each.withColumn("share", F.col("present") / F.nullif("applicable", F.lit(0)))


def adapted(rows: DataFrame, types: Mapping[str, str], first_of: Mapping[str, str], coalesced: Mapping[str, Sequence[str]]) -> DataFrame:
    """rows in a schema: columns that are missing are typed nulls, first_of takes the first entry of a list, coalesced the
    first of several columns that is there."""
    def of(name: str, kind: str) -> Column:
        if name in first_of:
            return F.try_element_at(F.col(first_of[name]), F.lit(1)).cast(kind)
        if name in coalesced:
            return F.coalesce(*[F.col(c) for c in coalesced[name] if c in rows.columns]).cast(kind)
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind)

    return rows.select(*[of(n, k).alias(n) for n, k in types.items()])
