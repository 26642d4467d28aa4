"""Intake of raw records: each is converted by a contract, or set aside with its reasons; no record stops the others.

A contract names fields, where they lie in a JSON record, and their types. A record is parsed once to a VARIANT. A
value of another type than its field's, a missing required value and a failed check are reasons; text that is no JSON
object is one too. Converted rows and records set aside go to two sinks, and a batch that is repeated after a failure
replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: JSON types that a field of a type may have. Dates are strings of a day.
KINDS = {"string": ("STRING",), "bigint": ("BIGINT",), "double": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "date": ("STRING",), "array<string>": ("ARRAY",)}
NO_OBJECT = "not a JSON object"


class Field(NamedTuple):
    """path: as in $.a.b; kind: one of KINDS."""

    path: str
    kind: str
    required: bool = False


def converted(raw: Column, contract: Mapping[str, Field]) -> Column:
    """struct(row, reasons): the typed fields of a record, null where wrong, and what is wrong with it, sorted."""
    parsed = F.try_parse_json(raw)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    values, reasons = [], [F.when(~is_object, F.lit(NO_OBJECT))]
    for name, field in contract.items():
        part = F.try_variant_get(parsed, field.path, "variant")
        kind = F.schema_of_variant(part)
        given = part.isNotNull() & (kind != "VOID")
        value = typed(parsed, field)
        right = F.coalesce(F.exists(F.array(*map(F.lit, KINDS[field.kind])), lambda k: kind.startswith(k)) & value.isNotNull(), F.lit(False))
        values.append(F.when(right, value).alias(name))
        wrong = F.when(given & ~right, F.lit(f"{name}: not {field.kind}"))
        reasons.append(F.when(is_object, F.coalesce(wrong, F.when(~F.coalesce(given, F.lit(False)), F.lit(f"{name}: missing")) if field.required else F.lit(None))))
    return F.struct(F.struct(*values).alias("row"), F.array_sort(F.array_compact(F.array(*reasons))).alias("reasons"))


def typed(parsed: Column, field: Field) -> Column:
    if field.kind == "date":
        text = F.try_variant_get(parsed, field.path, "string")
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    return F.try_variant_get(parsed, field.path, field.kind)


def intake(records: DataFrame, contract: Mapping[str, Field], checks: Mapping[str, Column] | None = None, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows of the contract's fields with digest, records set aside with reasons and digest).

    checks: name to a condition on the fields; an unknown condition holds. The digest is the SHA-256 of the raw text, so
    a record that comes again is known. Other columns of records pass through.
    """
    kept = [c for c in records.columns if c != raw]
    held = records.select(*[F.col(c).alias(f"__kept_{c}") for c in kept], F.col(raw).alias("__raw"), converted(F.col(raw), contract).alias("__c"))
    rows = held.select("*", "__c.row.*", F.sha2(F.coalesce("__raw", F.lit("")), 256).alias("digest"))
    failed = [F.when(~c, F.lit(n)) for n, c in (checks or {}).items()]
    rows = rows.withColumn("reasons", F.array_sort(F.array_compact(F.concat(F.col("__c.reasons"), F.array(*failed).cast("array<string>")))))
    passing = [F.col(f"__kept_{c}").alias(c) for c in kept]
    good = rows.filter(F.size("reasons") == 0).select(*passing, *contract, "digest")
    bad = rows.filter(F.size("reasons") > 0).select(*passing, F.col("__raw").alias(raw), F.array_join("reasons", "; ").alias("reasons"), "digest")
    return good, bad


def run_intake(spark: SparkSession, source: str, good: str, bad: str, checkpoint: str, contract: Mapping[str, Field], checks: Mapping[str, Column] | None = None, keys: Sequence[str] = (), files_per_batch: int = 8) -> None:
    """Converts all files of lines that were not taken in before. Of rows equal in keys within a batch one is kept."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source).withColumnRenamed("value", "raw")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        rows, aside = intake(batch.filter(F.trim("raw") != ""), contract, checks)
        (rows.dropDuplicates(list(keys)) if keys else rows).write.mode("overwrite").parquet(f"{good}/batch={number}")
        aside.write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    query = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
