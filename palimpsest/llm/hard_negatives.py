"""Hard negatives by a vector-approximation file.

Components become whole numbers, floor(scale * x). Each dimension's range is cut into CELLS cells, half of the borders at
quantiles and half in equal steps, and a vector is approximated by its cells, a byte each. For an anchor, a table gives for each cell
the least and the most that it can add to the inner product; adding these over a block's approximations bounds every
score. Only rows whose bounds let them enter a window are scored exactly.

First, an anchor's positives, its n_positives best rows of the same label: in each block a row whose upper bound is below
the n_positives-th lower bound can't be one. Then, for each positive, the window of scores low * p <= 100 * s <= high * p over
rows of other labels: a row whose bounds leave the window is out, and so is one whose upper bound is below the n_negatives-th
lower bound of rows that surely lie in it. The blocks' best are merged.

Rows are dealt to blocks of about BLOCK by hash, also of one label, anchors to sets of ANCHORS; a task holds one block and
one set. Every row is scored by bounds or exactly for every anchor; only the cells' borders, the same for all rows, come
from approximate quantiles, and bounds hold for any borders.

Rows without an id, label or vector, with a null or non-finite component, or with a whole number of LIMIT or more, whose
scores 64 bits need not hold, take no part. Of rows with one id the one of least label and vector counts. Vectors
of another length are another space; empty vectors all score 0. Equal scores are ranked by vec_id. Other columns may have
any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

CELLS, BLOCK, ANCHORS, AT_ONCE, LIMIT = 64, 8_192, 2_048, 32, 2**23
SCALE, N_POSITIVES, N_NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95

Best = tuple[np.ndarray, np.ndarray]


def usable(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): whole numbers of the rows that take part."""
    x = F.col("embedding")
    inside = F.forall(x, lambda v: v.isNotNull() & (F.abs(F.floor(scale * v)) < LIMIT) & (F.abs(v) < LIMIT))  # nan is above every number
    held = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), x.cast("array<double>").alias("embedding"))
    held = held.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & inside)
    whole = F.transform(x, lambda v: F.floor(scale * v)).cast("array<int>").alias("v")
    return held.groupBy("vec_id").agg(F.min(F.struct("label", whole)).alias("row")).select("vec_id", "row.label", "row.v")


def borders(rows: DataFrame, length: int) -> np.ndarray:
    """length x (CELLS + 1) borders of cells: the least value, approximate quantiles and equal steps, one above the most."""
    half = CELLS // 2
    shares = [i / half for i in range(1, half)]
    each = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.min("x"), F.percentile_approx("x", shares, 1_000), F.max("x") + 1)
    found = np.zeros((length, CELLS + 1), np.int64)
    for d, least, quantiles, most in each.collect():  # one row a dimension
        found[d] = np.sort([*np.linspace(least, most, half + 2).astype(np.int64), *quantiles])
    return found


def approximated(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """dimension x n bytes: the cells."""
    return np.stack([np.searchsorted(e[1:-1], c, "right") for e, c in zip(edges, v.T)]).astype(np.uint8) if len(edges) else np.zeros((0, len(v)), np.uint8)


def tables(anchors: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """dimension x cell x anchor: the least and the most that a cell adds to the anchor's score."""
    ends = anchors.T[:, None] * edges[:, :-1, None], anchors.T[:, None] * (edges[:, 1:, None] - 1)
    low, high = np.minimum(*ends), np.maximum(*ends)
    small = max(np.abs(low).max(axis=1, initial=0).sum(axis=0).max(initial=0), np.abs(high).max(axis=1, initial=0).sum(axis=0).max(initial=0)) < 2**31
    return (low.astype(np.int32), high.astype(np.int32)) if small else (low, high)


def bounds(cells: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores, row x anchor."""
    least = np.zeros((cells.shape[1], low.shape[2]), low.dtype)
    most = least.copy()
    for found, a, b in zip(cells, low, high):
        least += a[found]
        most += b[found]
    return least, most


def top(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:n]


def nth(values: np.ndarray, n: int) -> int | None:
    """The n-th largest."""
    return int(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else None


def best_positives(least: np.ndarray, most: np.ndarray, exact, ids: np.ndarray, n: int) -> Best:
    """Rows and scores of one anchor's best n rows, of those that `ids` names."""
    bound = nth(least, n)
    rows = np.arange(len(ids)) if bound is None else np.flatnonzero(most >= bound)
    score = exact(rows)
    kept = top(score, ids[rows], n)
    return rows[kept], score[kept]


def best_negatives(least: np.ndarray, most: np.ndarray, exact, ids: np.ndarray, window: tuple[int, int], n: int) -> Best:
    """Rows and scores of the best n rows of one anchor whose scores lie in a window."""
    begin, end = window
    sure = nth(least[(least >= begin) & (most <= end)], n)
    rows = np.flatnonzero((most >= (begin if sure is None else max(sure, begin))) & (least <= end))
    score = exact(rows)
    inside = (score >= begin) & (score <= end)
    rows, score = rows[inside], score[inside]
    kept = top(score, ids[rows], n)
    return rows[kept], score[kept]


def _searched(data: pd.DataFrame, anchors: pd.DataFrame, edges: np.ndarray, find) -> Iterator[tuple]:
    """What find(anchor, rows, least, most, exact) returns for each anchor: rows are those it may meet."""
    v = np.stack(data["v"]).astype(np.int64)
    ids, labels, cells = data["vec_id"].to_numpy(), data["label"].to_numpy(), approximated(v, edges)
    for begin in range(0, len(anchors), AT_ONCE):
        some = anchors.iloc[begin : begin + AT_ONCE]
        a = np.stack(some["v"]).astype(np.int64)
        least, most = bounds(cells, *tables(a, edges))
        for i, anchor in enumerate(some.itertuples(index=False)):
            yield from find(anchor, ids, labels, least[:, i], most[:, i], lambda rows, i=i: v[rows] @ a[i])


def _met(data: DataFrame, anchors: DataFrame, key: list[str], run, schema: str) -> DataFrame:
    """run(rows, anchors) for each block of rows and set of anchors with the same key."""
    sizes = data.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sets = anchors.groupBy(*key).agg(F.ceil(F.count("*") / ANCHORS).cast("int").alias("sets"))
    counts = stored(sizes.join(sets, key))
    part = lambda n, name: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int").alias(name)
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)
    left = data.join(counts, key).select(*data.columns, part("blocks", "block"), every("sets", "set"))
    right = anchors.join(counts, key).select(*anchors.columns, part("sets", "set"), every("blocks", "block"))
    cell = [*key, "block", "set"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(lambda d, a: run(d, a) if len(d) and len(a) else run(d[:0], a[:0]), schema)


def _frame(rows, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=names).astype("int64")


def positives(rows: DataFrame, anchors: DataFrame, edges: np.ndarray, n: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score): each anchor's best n rows of its label but its own."""
    names = ["anchor_id", "positive_id", "positive_score"]

    def find(anchor, ids, labels, least, most, exact):
        others = np.flatnonzero((ids != anchor.vec_id) & (labels == anchor.label))
        found, score = best_positives(least[others], most[others], lambda r: exact(others[r]), ids[others], n)
        return zip([anchor.vec_id] * len(found), ids[others[found]], score)

    def run(data: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return _frame(_searched(data, some, edges, find) if len(data) else [], names)

    found = _met(rows, anchors, ["label"], run, "anchor_id long, positive_id long, positive_score long")
    return _ranked(found, ["anchor_id"], "positive", n)


def _ranked(found: DataFrame, key: list[str], name: str, n: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc(f"{name}_score"), f"{name}_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def negatives(rows: DataFrame, anchors: DataFrame, edges: np.ndarray, n: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors with their `positives`,
    an array of (positive_id, positive_score)."""
    names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]

    def find(anchor, ids, labels, least, most, exact):
        others = np.flatnonzero((labels != anchor.label) & (ids != anchor.vec_id))
        for p in anchor.positives:
            positive, score = int(p["positive_id"]), int(p["positive_score"])
            window = -(-low * score // 100), high * score // 100
            if window[0] <= window[1]:
                found, scores = best_negatives(least[others], most[others], lambda r: exact(others[r]), ids[others], window, n)
                yield from ((anchor.vec_id, positive, i, score, s) for i, s in zip(ids[others[found]], scores))

    def run(data: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        return _frame(_searched(data, some, edges, find) if len(data) else [], names)

    found = _met(rows.withColumn("all", F.lit(0)), anchors.withColumn("all", F.lit(0)), ["all"], run, ", ".join(f"{c} long" for c in names))
    return _ranked(found, ["anchor_id", "positive_id", "positive_score"], "negative", n).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(vectors: DataFrame, is_anchor, scale: int = SCALE, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which is_anchor(vec_id)
    holds: for each of its positives, the best negatives of `low` to `high` percent of the positive's score."""
    held = stored(usable(vectors, scale))
    asked = held.filter(is_anchor(F.col("vec_id")))
    out = None
    for (length,) in asked.select(F.size("v").alias("n")).distinct().collect():
        rows, anchors = held.filter(F.size("v") == length), stored(asked.filter(F.size("v") == length))
        edges = borders(rows, length)
        near = stored(positives(rows, anchors, edges, n_positives))
        lists = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))  # n_positives at most
        part = negatives(rows, anchors.join(lists, "vec_id"), edges, n_negatives, low, high)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else held.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def moved(label: Column, vec_id: Column) -> Column:
    """The labels of the registered query: (label + 1) % 10 where 7 divides the id."""
    return F.when(vec_id % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return mine(vectors.withColumn("label", moved(F.col("label"), F.col("vec_id"))), lambda vec_id: vec_id % 50 == 0)
