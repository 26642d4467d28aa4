"""Sequence packing by power-of-two decomposition.

A document's ids are cut into full sequences and then the binary digits of what is left, longest
piece first, so every piece's length is a power of two and no sequence holds two documents. Pieces
of equal length are one bucket: their sequences are numbered one after another, so a batch can be
read from one bucket without padding.

Null text is the empty text: its end id alone. Rows with equal or null ids are packed one by one, repeated rows too.
Only doc_id and text are read, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import mapped, read, stored
from .encoding import encoder

PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("split", pa.int32()), ("nth", pa.int64())]
PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, split int, nth long"


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two, at most longest, in falling order, that add up to n."""
    full, left = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, longest: int = 4096, with_tokens: bool = True) -> DataFrame:
    """One row per piece of documents (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if with_tokens, tokens. longest must be a power of two.

    The pieces are stored first; then only counts per split of the input and length are gathered to
    number the sequences of each length.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    names = [name for name, _ in PIECE] + ["tokens"] * with_tokens

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts = TaskContext.get().partitionId(), dict[int, int]()
        for batch, ids, offsets in encoder(tokenizer).encoded(batches, 1, end_id):
            out: list[list] = [[] for _ in PIECE]
            raw = memoryview(ids).cast("B")
            for doc_id, begin, n in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), np.diff(offsets).tolist()):
                start = 0
                for length in binary_lengths(n, longest):
                    nth = counts[length] = counts.get(length, -1) + 1
                    at = begin + start
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), n, here, nth)):
                        column.append(value)
                    start += length
            columns = [pa.array(c, kind) for c, (_, kind) in zip(out, PIECE)]
            if with_tokens:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out[2])]), pa.int32()), pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names)

    pieces = stored(mapped(docs.select(F.col("doc_id").cast("long"), "text"), cut, PIECE_SQL + ", tokens array<int>" * with_tokens))
    counts = pieces.groupBy("length", "split").agg(F.count("*").alias("n"))
    before = Window.orderBy(F.desc("length"), "split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, ["length", "split"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["tokens"] * with_tokens
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_tokens=False)
