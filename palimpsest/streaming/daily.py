"""The daily job around the keyed state: feed window, gates, idempotent append."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.serving import insert_new
from ..operators.versions import latest_per
from ..sources.writers import exists
from .state import RECORD, stream_changes


class GateError(ValueError):
    """A batch that must not be applied."""


def feed_since(stored_latest: date, day: date, overlap_days: int = 3) -> date:
    """From which post date a day's feed is pulled: the earlier of the stored mark and the day, less an overlap."""
    return min(stored_latest, day) - timedelta(days=overlap_days)


def feed(log: DataFrame, key: str, version: str, posted: str, since: date, day: date) -> DataFrame:
    """What a source would send on a day: of each entity touched in [since, day] the latest record up to the day."""
    known = log.filter(F.col(posted) <= F.lit(day))
    touched = known.filter(F.col(posted) >= F.lit(since)).select(key).distinct()
    return latest_per(known.join(touched, key, "left_semi"), [key], version)


def null_gate(stored: DataFrame, batch: DataFrame, keys: Sequence[str], columns: Sequence[str], most: float = 0.01) -> None:
    """Stops where a column is newly null in more than a share of the rows that both sides have."""
    both = stored.select(*keys, F.struct(*columns).alias("a")).join(batch.select(*keys, F.struct(*columns).alias("b")), list(keys))
    shares = both.agg(*[F.avg((F.col(f"a.{c}").isNotNull() & F.col(f"b.{c}").isNull()).cast("int")).alias(c) for c in columns]).first()
    bad = [c for c in columns if (shares[c] or 0) > most]
    if bad:
        raise GateError(f"newly null: {', '.join(bad)}")


def overlap_gate(stored: DataFrame, batch: DataFrame, keys: Sequence[str], most: int = 5) -> None:
    """Stops where more than a few stored rows of the overlap did not come back."""
    missing = stored.select(*keys).join(batch.select(*keys), list(keys), "left_anti").limit(most + 1).count()
    if missing > most:
        raise GateError(f"over {most} stored rows of the overlap are missing")


def append_once(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str]) -> None:
    """Appends rows with new keys; a repeated batch adds nothing."""
    fresh = insert_new(spark.read.parquet(path), batch, keys) if exists(spark, path) else batch.dropDuplicates(list(keys))
    fresh.write.mode("append").parquet(path)


def run_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, terminal: frozenset[str], files_per_batch: int = 1) -> None:
    """Applies all record files of a folder that were not applied before, each batch appended once."""
    records = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    query = stream_changes(records, terminal).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
