"""Text components: sublinear TF-IDF over hashed words and its leading singular vectors.

The weighted words stay sparse and distributed. A block of features x (k + EXTRA) numbers, which does
not grow with the texts, is multiplied with them in each round: partitions add up what their texts
contribute, Spark sums the parts by feature, and the driver orthogonalizes the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES, EXTRA, ROUNDS, PART = 1 << 18, 8, 5, 1 << 14
WORD = r"(?U)\b[^\W\d_][\w\-]+\b"


@dataclass
class TextComponents:
    """n_texts and document_counts (feature, df) of the texts fitted on; basis: features x k."""

    n_texts: int
    document_counts: DataFrame
    basis: np.ndarray

    def transform(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """(key, components) of every row; zeros for texts without a known word."""
        shared, k = docs.sparkSession.sparkContext.broadcast(self.basis), self.basis.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = products(batch.column(1), batch.column(2), shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(np.round(values, 6) + 0.0), pa.list_(pa.float64()))], [key, "components"])

        counts = word_counts(docs, key, text, len(self.basis))
        kind = docs.schema[key].dataType.simpleString()
        found = weighted(counts, self.document_counts, self.n_texts).select("key", "terms", "weights").mapInArrow(run, f"`{key}` {kind}, components array<double>")
        zeros = F.array_repeat(F.lit(0.0), k)
        return docs.select(key).join(found, key, "left").select(key, F.coalesce("components", zeros).alias("components"))


def word_counts(docs: DataFrame, key: str, text: str, features: int) -> DataFrame:
    """(key, terms, counts) of hashed words, a row per key that has any. Words are counted where their text lies; only
    texts of a key that repeats are brought together."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    hashed = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))
    held = docs.select(F.col(key).alias("key"), hashed.alias("hashed")).filter(F.size("hashed") > 0)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            found = [np.unique(values[a:b], return_counts=True) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([n for _, n in found], pa.list_(pa.int64()))], ["key", "terms", "counts"])

    each = held.mapInArrow(run, f"key {kind}, terms array<int>, counts array<long>")
    again = docs.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).filter("n > 1").select("again").checkpoint()
    if not again.limit(1).count():
        return each
    same = F.col("key").eqNullSafe(F.col("again"))
    several = each.join(again, same, "left_semi").select("key", F.explode(F.arrays_zip("terms", "counts")).alias("t"))
    several = several.groupBy("key", "t.terms").agg(F.sum("t.counts").alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("terms", "n"))).alias("t"))
    return each.join(again, same, "left_anti").unionByName(several.select("key", F.col("t.terms").alias("terms"), F.col("t.n").alias("counts")))


def weighted(counts: DataFrame, document_counts: DataFrame, n_texts: int) -> DataFrame:
    """(key, terms, weights): (1 + log n) * (log((1 + texts) / (1 + df)) + 1), scaled to length 1; unseen terms drop out.
    Every task gets the document counts, one number per feature."""
    df = document_counts.toArrow()
    held = np.zeros(max(df.column("term").to_pylist(), default=-1) + 1)
    held[df.column("term").to_numpy()] = np.log((1.0 + n_texts) / (1.0 + df.column("df").to_numpy())) + 1.0
    shared = counts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = shared.value
        for batch in batches:
            rows = []
            for key, terms, n in zip(*(c for c in batch.columns)):
                t, n = terms.values.to_numpy(), n.values.to_numpy()
                seen = t < len(idf)
                w = np.where(seen, idf[np.minimum(t, len(idf) - 1)], 0.0) * (1.0 + np.log(n)) if len(idf) else np.zeros(len(t))
                t, w = t[w > 0], w[w > 0]
                if len(t):
                    rows.append((key, t, w / np.sqrt((w * w).sum())))
            keys, terms, weights = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["key", "terms", "weights"])

    return counts.mapInArrow(run, f"key {counts.schema['key'].dataType.simpleString()}, terms array<int>, weights array<double>")


def flat(terms: pa.ListArray, weights: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    offsets = terms.offsets.to_numpy()
    return terms.values.to_numpy(), weights.values.to_numpy(), offsets


def products(terms: pa.ListArray, weights: pa.ListArray, block: np.ndarray) -> np.ndarray:
    """Each row's sum of weight times the block's row of the term."""
    t, w, offsets = flat(terms, weights)
    out = np.zeros((len(offsets) - 1, block.shape[1]))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        out[i] = w[a:b] @ block[t[a:b]]
    return out


def multiplied(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """The matrix of rows, transposed, times the matrix, times the block."""
    shared, width = rows.sparkSession.sparkContext.broadcast(block), block.shape[1]
    names = [f"z{i}" for i in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(block)
        for batch in batches:
            t, w, offsets = flat(batch.column(0), batch.column(1))
            y = products(batch.column(0), batch.column(1), shared.value)
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):  # terms are distinct within a row
                total[t[a:b]] += w[a:b, None] * y[i]
        used = np.flatnonzero(total.any(axis=1))
        for at in range(0, len(used), PART):
            some = used[at : at + PART]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, i]) for i in range(width)]], ["term", *names])

    tasks = rows.sparkSession.sparkContext.defaultParallelism  # each returns a block, so no more of them than run at once
    parts = rows.select("terms", "weights").coalesce(tasks).mapInArrow(run, "term int, " + ", ".join(f"{n} double" for n in names))
    sums = parts.groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros_like(block)
    out[sums.column("term").to_numpy()] = np.column_stack([sums.column(n).to_numpy() for n in names])
    return out


def fit_components(docs: DataFrame, key: str, text: str, k: int = 32, features: int = FEATURES, seed: int = 7) -> TextComponents:
    """Fits on the texts of docs; needs checkpoints, as every round reads the weighted words again. Components that the
    texts cannot support are 0, and each has its largest entry positive."""
    counts = word_counts(docs, key, text, features).checkpoint()
    document_counts = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).checkpoint()
    n_texts = docs.count()
    rows = weighted(counts, document_counts, n_texts).checkpoint()
    block = np.random.default_rng(seed).normal(size=(features, k + EXTRA))
    for _ in range(ROUNDS):
        basis = np.linalg.qr(block)[0]
        block = multiplied(rows, basis)
    values, vectors = np.linalg.eigh(basis.T @ block)
    order = np.argsort(-values)[:k]
    found = basis @ vectors[:, order]
    found[:, values[order] <= 1e-9 * max(values.max(), 1e-300)] = 0.0
    top = np.abs(found).argmax(axis=0)
    found *= np.where(found[top, np.arange(found.shape[1])] < 0, -1.0, 1.0)
    return TextComponents(n_texts, document_counts, found)
