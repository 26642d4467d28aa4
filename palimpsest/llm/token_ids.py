"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

`write_token_ids` range-partitions documents by id, encodes inside each sorted range and writes one
ORC file per range, so files, stripes and rows ascend by document id. A reader prunes stripes by
the statistics of doc_id, skips rows by row index and Bloom filter, and reads stripes in parallel.

Null text is the empty text: the end id alone. Null ids sort first; equal ids are ordered by text, repeated rows are
each written. Only doc_id and text are read, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, read, to_batch, work_folder
from .encoding import encoder

STORED = "doc_id long, range int, begins long, n_tokens long, tokens array<int>"
STRIPE_BYTES, STRIDE = 64 << 20, 1_000


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Encode documents (doc_id, text) and write them in ascending doc_id order to ORC at path.

    Columns: doc_id; range, the number of the file; begins, ids of the file's earlier documents;
    n_tokens, with the end id; tokens.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("range", pa.int32()), ("begins", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, here = 0, TaskContext.get().partitionId()
        for batch, ids, offsets in encoder(tokenizer).encoded(batches, 1, end_id):
            sizes = np.diff(offsets)
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view("<i4")))
            yield to_batch(schema, [batch.column(0), np.full(len(sizes), here, np.int32), at + offsets[:-1], sizes, tokens])
            at += int(offsets[-1])

    ranged = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        mapped(ranged, encode, STORED)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", STRIDE)
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("compression", "snappy")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with start, the number of ids of all documents before."""
    return with_starts(spark.read.schema(STORED).orc(path), path)


def with_starts(rows: DataFrame, path: str) -> DataFrame:
    """Adds start to rows of the files at path, in place of range and begins: one number per file is carried over."""
    totals = rows.sparkSession.read.schema(STORED).orc(path).groupBy("range").agg(F.max(F.col("begins") + F.col("n_tokens")).alias("total"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "range").withColumn("start", F.col("base") + F.col("begins")).drop("range", "begins", "base")


def token_checksums(rows: DataFrame) -> DataFrame:
    """crc32 of each row's ids as little-endian unsigned 32-bit integers, in place of the ids."""
    kept = [f for f in rows.schema.fields if f.name != "tokens"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            offsets = lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], crc], [*batch.schema.names[:-1], "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", ids_crc32 long"
    return mapped(rows.select(*[f.name for f in kept], "tokens"), sums, schema)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_folder(spark)
    write_token_ids(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return with_starts(token_checksums(spark.read.schema(STORED).orc(path)), path).select("doc_id", "start", "n_tokens", "ids_crc32")
