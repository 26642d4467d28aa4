"""Approximate nearest neighbours with a permutation index.

A vector is represented by its nearest pivots in order and lies in the cell of the nearest of the
first CELLS pivots. A query is joined with the cells of its `probes` nearest of these. In a block of
a cell each pivot has an inverted file of the vectors that list it, and at which rank; meeting it with
the queries that list the pivot adds up what shared pivots take off the greatest footrule distance.
Vectors at least as near by footrule as `near`, or else the 8 * k nearest of the block, are reranked by exact
cosine, and the blocks' best are merged.

`calibrate` sets probes and near on a bounded sample of at most SAMPLE distinct vectors, so that each
loses at most half of the share of true neighbours that `recall` leaves. In larger data neighbours
are nearer, so the loss falls. recall=1 probes every cell and reranks every vector, which is exact.

Pivots are N_PIVOTS distinct vectors of least hash; every vector is indexed. Equal vectors are indexed
once with their smallest ids; ties of score go to the smaller id. Vectors of another length are
another space. Vectors that are null, empty, zero, or hold a null or non-finite component, and rows
without an id, take no part; repeated rows count once. Only vec_id and embedding are read, so further
columns may have any names. A table without vectors gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read, stored

N_PIVOTS, LISTED, CELLS, SAMPLE, BLOCK, QUERIES = 256, 64, 64, 8_192, 16_384, 4_096
RECALL, AT_ONCE = 0.98, 256


def usable(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0))


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def weights(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """What each pivot counts for each unit vector: LISTED for the nearest, one less for each further, 0 if not listed."""
    listed = min(LISTED, len(pivots))
    order = np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :listed]
    found = np.zeros((len(x), len(pivots)), np.int16)
    np.put_along_axis(found, order, np.arange(listed, 0, -1, dtype=np.int16)[None], axis=1)
    return found


def nearness(data: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """For queries by data, how far their footrule distance lies below the greatest: twice the smaller weight of each
    shared pivot, added up pivot by pivot over its inverted files."""
    found = np.zeros((len(queries), len(data)), np.int32)
    for pivot in range(data.shape[1]):
        rows, asking = np.flatnonzero(data[:, pivot]), np.flatnonzero(queries[:, pivot])
        if len(rows) and len(asking):
            found[np.ix_(asking, rows)] += 2 * np.minimum(queries[asking, pivot][:, None], data[rows, pivot][None])
    return found


def calibrate(sample: np.ndarray, pivots: np.ndarray, best: int, recall: float) -> tuple[int, int]:
    """(probes, near) that keep the asked share of the sample's true neighbours; queries are those that are no pivots."""
    cells = min(CELLS, len(pivots))
    x, p = units(sample), units(pivots)
    asked = np.arange(len(p), len(x))[-512:]
    if recall >= 1 or len(asked) < 32:
        return cells, 0
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -np.inf
    true = np.argsort(-cosine, axis=1)[:, : min(best, len(x) - 1)]
    to_cells = x @ p[:cells].T
    ranks = np.argsort(np.argsort(-to_cells[asked], axis=1), axis=1)
    probe = np.take_along_axis(ranks, to_cells.argmax(axis=1)[true], axis=1)
    held = weights(x, p)
    by_footrule = np.concatenate([np.take_along_axis(nearness(held, held[part]), true[part - asked[0]], axis=1) for part in np.array_split(asked, 4)])
    lost = (1 - recall) / 2
    return int(np.quantile(probe, 1 - lost)) + 1, int(np.quantile(by_footrule, lost))


def search_block(data: np.ndarray, queries: np.ndarray, pivots: np.ndarray, best: int, near: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, data row and cosine of each query's `best` rows of a block."""
    d, q, p = units(data), units(queries), units(pivots)
    held, found, least = weights(d, p), [], min(len(d), 8 * best)
    for begin in range(0, len(q), AT_ONCE):
        some = q[begin : begin + AT_ONCE]
        for i, row in enumerate(nearness(held, weights(some, p)) if near > 0 else np.zeros((len(some), len(d)), np.int32)):
            kept = np.flatnonzero(row >= near)
            if len(kept) < least:
                kept = np.argpartition(-row, least - 1)[:least]
            cosine = d[kept] @ some[i]
            top = kept[np.lexsort((kept, -cosine))[:best]]
            found.append((np.full(len(top), begin + i), top, (d[top] * some[i]).sum(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*found))


def nearest(vectors: DataFrame, is_query, k: int = 5, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows nearest to each row for which is_query(vec_id) holds, but its own."""
    held = usable(vectors)
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    few = held.distinct().withColumn("n", F.row_number().over(by_id)).filter(F.col("n") <= k + 1)
    classes = stored(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("class", F.col("ids")[0]))
    asked = stored(held.filter(is_query(F.col("vec_id"))).select("vec_id", "embedding").distinct())
    found = None
    for row in classes.groupBy(F.size("embedding").alias("length")).count().collect():
        part = _search(classes.filter(F.size("embedding") == row["length"]), asked.filter(F.size("embedding") == row["length"]), k, recall)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return held.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    best = Window.partitionBy("query_class").orderBy(F.desc("score"), "class")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1)
    lists = top.groupBy("query_class").agg(F.collect_list(F.struct("score", "ids")).alias("near"))
    owners = asked.join(classes.select("embedding", F.col("class").alias("query_class")), "embedding").select(F.col("vec_id").alias("query_id"), "query_class")
    entry = lambda s: F.transform(s["ids"], lambda i: F.struct((-s["score"]).alias("far"), i.alias("vec_id")))
    near = F.filter(F.array_sort(F.flatten(F.transform("near", entry))), lambda e: e["vec_id"] != F.col("query_id"))
    ranked = owners.join(lists, "query_class").select("query_id", F.posexplode(F.slice(near, 1, k)).alias("at", "found"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("found.vec_id").alias("vec_id"), (-F.col("found.far")).alias("score"))


def _search(classes: DataFrame, asked: DataFrame, k: int, recall: float) -> DataFrame:
    spark = classes.sparkSession
    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("embedding"), "class").limit(SAMPLE).select("embedding").collect()])
    pivots = sample[: min(N_PIVOTS, max(1, len(sample) // 2))]
    probes, near = calibrate(sample, pivots, k, recall)
    cells = spark.sparkContext.broadcast(units(pivots[:CELLS]))
    shared = spark.sparkContext.broadcast(pivots)

    def placed(n: int):
        """Adds the `n` nearest cells of each vector, one a row."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    order = np.argsort(-(units(np.stack(frame["embedding"])) @ cells.value.T), axis=1, kind="stable")[:, :n]
                    yield frame.loc[frame.index.repeat(order.shape[1])].assign(cell=order.ravel())

        return run

    held = classes.select("class", "ids", "embedding").mapInPandas(placed(1), "class long, ids array<long>, embedding array<double>, cell int")
    held = stored(held)
    sizes = F.broadcast(stored(held.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))))  # CELLS rows at most
    queries = asked.select("embedding").distinct().join(classes, "embedding").select("class", "embedding")
    queries = queries.mapInPandas(placed(probes), "class long, embedding array<double>, cell int")
    queries = stored(queries.join(sizes, "cell"))
    sets = F.broadcast(stored(queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("sets"))))  # CELLS rows at most
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    part = lambda count: F.pmod(F.xxhash64("class"), F.col(count)).cast("int")
    data = held.join(sizes, "cell").join(sets, "cell").select("cell", part("blocks").alias("block"), every("sets").alias("set"), "class", "ids", "embedding")
    dealt = queries.join(sets, "cell").select("cell", part("sets").alias("set"), every("blocks").alias("block"), "class", "embedding")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_class": [], "class": [], "ids": [], "score": []})
        left = left.sort_values("class").reset_index(drop=True)
        q, row, score = search_block(np.stack(left["embedding"]), np.stack(right["embedding"]), shared.value, k + 1, near)
        return pd.DataFrame({"query_class": right["class"].to_numpy()[q], "class": left["class"].to_numpy()[row], "ids": left["ids"].to_numpy()[row], "score": score})

    key = ["cell", "block", "set"]
    return data.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInPandas(run, "query_class long, class long, ids array<long>, score double")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)
