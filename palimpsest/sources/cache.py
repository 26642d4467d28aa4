"""A cache of what is derived from texts, signed by the settings that derived it."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import checksum
from .writers import exists


class StaleCache(ValueError):
    """A cache that other settings derived, or whose rows are not those that were stored."""


class TextCache:
    """An append-only store of (digest, columns of `compute`) for distinct texts.

    Each batch lies in its own folder with a seal: the settings' signature, the number of rows and their checksum. A batch
    is complete once its seal is written, which comes last; one that was interrupted is not read, and is computed again.
    """

    def __init__(self, spark: SparkSession, path: str, settings: Mapping[str, Any]) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.signature = hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()

    def _seals(self) -> list:
        seals = f"{self.path}/seals"
        return self.spark.read.parquet(seals).collect() if exists(self.spark, seals) else []  # a row a batch

    def held(self) -> DataFrame | None:
        """All stored rows; StaleCache if a batch has another signature."""
        seals = self._seals()
        if any(s["signature"] != self.signature for s in seals):
            raise StaleCache(f"{self.path} was derived by other settings")
        return self.spark.read.parquet(*[f"{self.path}/rows/{s['batch']}" for s in seals]).dropDuplicates(["digest"]) if seals else None

    def verify(self) -> None:
        """StaleCache if a batch does not hold the rows that were stored."""
        for s in self._seals():
            found = checksum(self.spark.read.parquet(f"{self.path}/rows/{s['batch']}")).first()
            if (found["n_rows"], str(found["checksum"])) != (s["n_rows"], s["checksum"]):
                raise StaleCache(f"batch {s['batch']} of {self.path} was changed")

    def missing(self, texts: DataFrame, column: str) -> DataFrame:
        """(digest, text) of the distinct texts that are not stored; null is no text."""
        asked = texts.filter(F.col(column).isNotNull()).select(F.sha2(column, 256).alias("digest"), F.col(column).alias("text")).dropDuplicates(["digest"])
        held = self.held()
        return asked if held is None else asked.join(held.select("digest"), "digest", "left_anti")

    def add(self, texts: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Stores compute(digest, text) for the texts that are not stored; returns how many rows were computed."""
        missing = self.missing(texts, column)
        if missing.limit(1).count() == 0:
            return 0
        batch = f"batch-{len(self._seals()):06d}"
        folder = f"{self.path}/rows/{batch}"
        compute(missing).write.mode("overwrite").parquet(folder)
        rows = checksum(self.spark.read.parquet(folder)).first()
        seal = [(batch, self.signature, rows["n_rows"], str(rows["checksum"]))]
        self.spark.createDataFrame(seal, "batch string, signature string, n_rows long, checksum string").coalesce(1).write.mode("append").parquet(f"{self.path}/seals")
        return rows["n_rows"]

    def joined(self, texts: DataFrame, column: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """texts with the columns of compute, null for a null text; only what is not stored is computed."""
        self.add(texts, column, compute)
        held = self.held()
        keyed = texts.withColumn("digest", F.sha2(column, 256))
        return (keyed.join(held, "digest", "left") if held is not None else compute(keyed.limit(0).select("digest", F.col(column).alias("text"))).join(keyed, "digest", "right")).drop("digest")
