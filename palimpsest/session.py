"""Spark sessions with the settings that the library's results rely on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "palimpsest", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as spark.checkpoint.dir names it; checkpoints go there too.

    Where the setting is missing, a session on one machine gets a folder of its own; a cluster has no such place, and
    RuntimeError is raised.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
    if not held.isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, which goes when the driver ends."""
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet below the shared folder and read again: several steps read it without planning it
    anew, and it survives executors. The files go when the driver ends."""
    spark = frame.sparkSession
    path = scratch_folder(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have gone before
        pass
