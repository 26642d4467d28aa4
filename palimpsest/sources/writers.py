"""Writers: sorted and checked Parquet, staged replacement, retention, backups, compaction."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import checksum


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at(path))


def replace(spark: SparkSession, staged: str, path: str) -> None:
    """Puts a finished folder in the place of the previous one, which is moved aside first and comes back on failure."""
    fs, at = _fs(spark, path)
    aside = f"{path}.previous"
    if fs.exists(at(aside)):  # an earlier run stopped half-way
        if fs.exists(at(path)):
            fs.delete(at(aside), True)
        elif not fs.rename(at(aside), at(path)):
            raise OSError(f"cannot restore {path}")
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(aside)):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(at(staged), at(path)):
        if had:
            fs.rename(at(aside), at(path))
        raise OSError(f"cannot rename {staged}")
    if had:
        fs.delete(at(aside), True)


def write_table(rows: DataFrame, path: str, order: Sequence[str | Column], block_bytes: int | None = None) -> dict:
    """Writes rows, range-sorted so that files and their statistics are ordered, next to path, reads them back, and
    only then replaces path. Returns rows and checksum of what was read."""
    spark, staged = rows.sparkSession, f"{path}.building"
    writer = rows.orderBy(*order).write.mode("overwrite").option("compression", "zstd")
    if block_bytes:
        writer = writer.option("parquet.block.size", block_bytes)
    writer.parquet(staged)
    found = checksum(spark.read.parquet(staged)).first()
    replace(spark, staged, path)
    return {"rows": found["n_rows"], "checksum": str(found["checksum"])}


def write_manifest(spark: SparkSession, path: str, tables: Mapping[str, dict]) -> dict[str, str]:
    """Stores rows and checksums of a build; says of each table whether it equals the previous build's."""
    before = {}
    if exists(spark, path):
        before = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    spark.createDataFrame([(json.dumps(tables, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return {t: "new" if t not in before else "identical" if before[t] == v else "changed" for t, v in tables.items()}


def retain(spark: SparkSession, path: str, old: Column, archive: str) -> dict:
    """Moves rows for which `old` holds to an archive: exported, read back, compared, and only then dropped here.

    Each run adds a folder batch=<checksum of its rows> to the archive, so earlier runs stay, and a run that is repeated
    after it stopped half-way writes the same folder again.
    """
    rows = spark.read.parquet(path)
    leaving, staying = rows.filter(old), rows.filter(~F.coalesce(old, F.lit(False)))
    want = checksum(leaving).first()
    if not want["n_rows"]:
        return {"archived": 0, "checksum": str(want["checksum"])}
    batch = f"{archive}/batch={want['checksum']}"
    leaving.write.mode("overwrite").parquet(batch)
    if want != checksum(spark.read.schema(rows.schema).parquet(batch)).first():
        raise OSError("the archive differs from the rows to drop")
    staying.write.mode("overwrite").parquet(f"{path}.building")
    replace(spark, f"{path}.building", path)
    return {"archived": want["n_rows"], "checksum": str(want["checksum"])}


def write_month(rows: DataFrame, path: str, month: str) -> None:
    """Replaces the month partitions that rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(month).parquet(path)


def compact(spark: SparkSession, path: str, file_bytes: int = 256 << 20) -> None:
    """Rewrites a folder of small files in files of about a size."""
    fs, at = _fs(spark, path)
    files = max(1, -(-fs.getContentSummary(at(path)).getLength() // file_bytes))
    spark.read.parquet(path).repartition(int(files)).write.mode("overwrite").parquet(f"{path}.building")
    replace(spark, f"{path}.building", path)


def backup(spark: SparkSession, folder: str, tables: Sequence[str], to: str) -> dict[str, dict]:
    found = {}
    for t in tables:
        rows = spark.read.parquet(f"{folder}/{t}")
        rows.write.mode("overwrite").parquet(f"{to}/{t}")
        r = checksum(spark.read.parquet(f"{to}/{t}")).first()
        found[t] = {"rows": r["n_rows"], "checksum": str(r["checksum"])}
    return found


def restore(spark: SparkSession, backed_up: str, manifest: Mapping[str, dict], to: str) -> None:
    """Copies tables back, each only if it still has the rows and checksum of the manifest."""
    for t, want in manifest.items():
        rows = spark.read.parquet(f"{backed_up}/{t}")
        r = checksum(rows).first()
        if r["n_rows"] != want["rows"] or Decimal(want["checksum"]) != r["checksum"]:
            raise OSError(f"{t} differs from its manifest")
        rows.write.mode("overwrite").parquet(f"{to}/{t}")
