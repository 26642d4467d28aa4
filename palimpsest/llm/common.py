"""Helpers that several training-data operators share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

CHUNK_CHARS, BATCH_BYTES = 2_000_000, 8 << 20

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; deleted when the driver ends."""
    path = f"{shared_folder(spark)}/palimpsest-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have gone before
        pass


def stored(df: DataFrame) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again: cuts lineage, survives executors."""
    path = work_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(frame: DataFrame) -> DataFrame:
    """The frame as a side of a join that both sides are shuffled for. For tables that grow with the input: Spark sizes a stored
    frame by its compressed file, a column by its type and an explode not at all, and would broadcast what it so takes for small."""
    return frame.hint("merge")


def mapped(frame: DataFrame, run: Mapper, schema: str) -> DataFrame:
    """frame.mapInArrow(run, schema), with the session's Arrow batches bounded in bytes, as whole texts can be long; what
    a task's batches took is given back when it ends."""
    frame.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return frame.mapInArrow(task, schema)


def in_slices(columns: int, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of at most about CHUNK_CHARS characters of text at a time; one long text may exceed it alone."""
    for batch in batches:
        cols = [batch.column(i) for i in range(columns)]
        lengths = pc.fill_null(pc.binary_length(cols[text_at]), 0).to_pylist()
        begin, size = 0, 0
        for i, n in enumerate(lengths):
            if i > begin and size + n > CHUNK_CHARS:
                yield [c.slice(begin, i - begin) for c in cols]
                begin, size = i, 0
            size += n
        if lengths:
            yield [c.slice(begin) for c in cols]


def in_batches(columns: int, text_at: int, batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of in_slices as Python lists."""
    for cols in in_slices(columns, text_at, batches):
        yield [c.to_pylist() for c in cols]


def to_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds
