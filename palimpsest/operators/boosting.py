"""Boosted trees of several classes by histograms, and what each feature adds to a row's margin.

Values are binned once at approximate quantiles. In each round every class gets a tree, grown level by level: tasks add up
gradients and curvatures by (class, node, feature, bin) in Arrow batches, Spark sums them over tasks, and only these sums reach the
driver, which picks the splits. Rows carry their margins from every REFRESH-th round on, so that a round evaluates few trees.
Rows flagged for validation don't train; their loss ends the fit when it has not fallen for `patience` rounds.

A missing value lies in the lowest bin. Trees are complete: a node that is not split passes its value down to its leaves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

REFRESH = 8


class Tree(NamedTuple):
    """Of the inner nodes, by level: the feature and the last bin that goes left (-1: no split, all go left); of all nodes
    the weight of their rows; of the leaves the value."""

    feature: np.ndarray
    last: np.ndarray
    cover: np.ndarray
    value: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1


class Boosted(NamedTuple):
    features: list[str]
    borders: list[list[float]]
    start: np.ndarray
    rounds: list[list[Tree]]
    losses: list[float]


def leaf_of(tree: Tree, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
    """Number within its level of the node of each row (bins: row x feature)."""
    at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    for level in range(tree.depth if levels is None else levels):
        node = at + (1 << level) - 1
        feature = tree.feature[node]
        at = 2 * at + ((feature >= 0) & (bins[rows, np.maximum(feature, 0)] > tree.last[node]))
    return at


def margins(start: np.ndarray, rounds: list[list[Tree]], bins: np.ndarray) -> np.ndarray:
    found = np.repeat(start[None], len(bins), axis=0) if start.ndim == 1 else start.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            found[:, k] += tree.value[leaf_of(tree, bins)]
    return found


def softmax(margin: np.ndarray) -> np.ndarray:
    e = np.exp(margin - margin.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def borders_of(rows: DataFrame, features: Sequence[str], n_bins: int) -> list[list[float]]:
    """Distinct quantiles of each feature; n_bins - 1 at most."""
    shares = [i / n_bins for i in range(1, n_bins)]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 10_000).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(found[f"q{i}"] or [])) for i in range(len(features))]


def binned(columns: list[pa.Array], borders: list[list[float]]) -> np.ndarray:
    """row x feature bins: 0 for a missing value, else one more than the borders below it."""
    out = []
    for column, cuts in zip(columns, borders):
        x = column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        out.append(np.where(np.isnan(x), 0, np.searchsorted(cuts, x, "left") + 1))
    return np.stack(out, axis=1).astype(np.uint8) if out else np.zeros((0, 0), np.uint8)


def _split(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[int, int]:
    """Feature and last left bin of the best split of a node (g, h: feature x bin), or -1, -1."""
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
    score = lambda a, b: a * a / (b + ridge)
    gain = score(left_g, left_h) + score(all_g - left_g, all_h - left_h) - score(all_g, all_h)
    gain[(left_h < least) | (all_h - left_h < least)] = -np.inf
    best = int(gain.argmax()) if gain.size else 0
    feature, last = divmod(best, gain.shape[1]) if gain.size else (-1, -1)
    return (feature, last) if gain.size and gain[feature, last] > 1e-9 else (-1, -1)


def fit(rows: DataFrame, features: Sequence[str], label: str, classes: int, weight: str | None = None, validation: str | None = None, rounds: int = 50, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 5.0, n_bins: int = 32, patience: int = 5) -> Boosted:
    """A model of the label (0 .. classes - 1). least: curvature that each side of a split must have."""
    n = len(features)
    flagged = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    weighted = F.col(weight).cast("double") if weight else F.lit(1.0)
    held = rows.filter(F.col(label).isNotNull()).select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), F.col(label).cast("int").alias("y"), weighted.alias("w"), flagged.alias("v"))
    train = rows.filter(~flagged)
    borders = borders_of(train, features, n_bins)
    shares = np.zeros(classes)
    for y, total in held.filter(~F.col("v")).groupBy("y").agg(F.sum("w")).collect():  # a row a class
        shares[y] = total
    start = np.log(np.maximum(shares / max(shares.sum(), 1e-12), 1e-9))

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten()
            bins = binned([x.take(pa.array(np.arange(i, len(x), n))) for i in range(n)], borders)
            margin = np.repeat(start[None], batch.num_rows, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), pa.array([m.tobytes() for m in margin], pa.binary()), *batch.columns[1:]], ["bins", "margin", "y", "w", "v"])

    table = stored(held.mapInArrow(to_bins, "bins binary, margin binary, y int, w double, v boolean"))
    done: list[list[Tree]] = []
    recent: list[list[Tree]] = []
    losses: list[float] = []

    def summed(growing: list[Tree], level: int) -> tuple[np.ndarray, float]:
        """class x node x feature x bin x (g, h, weight), and the validation loss of the finished rounds."""
        size = (classes, 1 << level, n, n_bins + 1, 3)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, loss = np.zeros(size), np.zeros(2)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n)
                margin = margins(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, classes), recent, bins)
                y, w, v = batch.column(2).to_numpy(), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
                p = softmax(margin)
                loss += [-(w[v] * np.log(np.maximum(p[v, y[v]], 1e-15))).sum(), w[v].sum()]
                bins, y, w, p = bins[~v], y[~v], w[~v], p[~v]
                for k in range(classes):
                    g, h = w * (p[:, k] - (y == k)), w * p[:, k] * (1 - p[:, k])
                    node = leaf_of(growing[k], bins, level)
                    for f in range(n):
                        cell = node * (n_bins + 1) + bins[:, f]
                        for i, values in enumerate((g, h, w)):
                            total[k, :, f, :, i] += np.bincount(cell, values, (n_bins + 1) << level).reshape(1 << level, n_bins + 1)
            flat = np.concatenate([total.ravel(), loss])
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], ["at", "value"])

        found = np.zeros(int(np.prod(size)) + 2)
        for at, value in table.mapInArrow(task, "at long, value double").groupBy("at").agg(F.sum("value")).collect():  # histograms only
            found[at] = value
        return found[:-2].reshape(size), found[-2] / found[-1] if found[-1] else math.nan

    for _ in range(rounds):
        growing = [Tree(np.full((1 << depth) - 1, -1), np.full((1 << depth) - 1, -1), np.zeros((2 << depth) - 1), np.zeros(1 << depth)) for _ in range(classes)]
        values: list[dict[tuple[int, int], float]] = [{} for _ in range(classes)]
        for level in range(depth):
            sums, loss = summed(growing, level)
            if level == 0 and validation:
                losses.append(float(loss))
                if len(losses) > patience and min(losses[-patience:]) >= min(losses[:-patience]):
                    best = int(np.argmin(losses))
                    return Boosted(list(features), borders, start, done[:best], losses)
            for k, node in product(range(classes), range(1 << level)):
                g, h, w = (sums[k, node, :, :, i] for i in range(3))
                at = node + (1 << level) - 1
                growing[k].cover[at] = w[0].sum() if n else 0.0
                values[k][level, node] = -rate * g[0].sum() / (h[0].sum() + ridge)
                feature, last = _split(g, h, ridge, least)
                growing[k].feature[at], growing[k].last[at] = feature, last
                if level == depth - 1:
                    sides = [(g[feature, : last + 1].sum(), h[feature, : last + 1].sum(), w[feature, : last + 1].sum()), (g[feature, last + 1 :].sum(), h[feature, last + 1 :].sum(), w[feature, last + 1 :].sum())] if feature >= 0 else [(g[0].sum(), h[0].sum(), w[0].sum()), (0.0, 0.0, 0.0)]
                    for side, (sg, sh, sw) in enumerate(sides):
                        growing[k].value[2 * node + side] = -rate * sg / (sh + ridge)
                        growing[k].cover[2 * node + side + (1 << depth) - 1] = sw
        done.append(growing)
        recent.append(growing)
        if len(recent) == REFRESH:
            table, recent = stored(_moved(table, list(recent), n, classes)), []
    return Boosted(list(features), borders, start, done, losses)


def _moved(table: DataFrame, rounds: list[list[Tree]], n: int, classes: int) -> DataFrame:
    """The table with margins after further rounds."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n)
            margin = margins(np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, classes), rounds, bins)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in margin], pa.binary()), *batch.columns[2:]], ["bins", "margin", "y", "w", "v"])

    return table.mapInArrow(task, "bins binary, margin binary, y int, w double, v boolean")


def added_by(tree: Tree, bins: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """row x feature: each feature's Shapley value in a tree, and the tree's expected value.

    Each leaf is a game of the features on its path: a known feature counts 1 where the row keeps to the path and 0 where it
    leaves it, an unknown one the share of rows that keep to it. The value of a product of players follows from the
    coefficients of a polynomial in the number of players that are known.
    """
    out, expected = np.zeros((len(bins), n_features)), 0.0
    for leaf, value in enumerate(tree.value):
        if not value:
            continue
        share: dict[int, float] = {}
        keeps: dict[int, np.ndarray] = {}
        reached = True
        for level in range(tree.depth):
            at, right = leaf >> (tree.depth - level), leaf >> (tree.depth - level - 1) & 1
            node = at + (1 << level) - 1
            f = int(tree.feature[node])
            if f < 0:
                reached = reached and not right
                continue
            below = (2 * at + right) + (2 << level) - 1
            part = tree.cover[below] / tree.cover[node] if tree.cover[node] > 0 else 0.0
            side = (bins[:, f] > tree.last[node]) == bool(right)
            share[f] = share.get(f, 1.0) * part
            keeps[f] = keeps[f] & side if f in keeps else side
        if not reached:
            continue
        expected += value * math.prod(share.values())
        players = list(share)
        d = len(players)
        for i in players:
            terms = [np.ones(len(bins))]  # by the number of known players among the others
            for j in players:
                if j != i:
                    known, unknown = keeps[j].astype(float), share[j]
                    terms = [(terms[c] * unknown if c < len(terms) else 0.0) + (terms[c - 1] * known if c else 0.0) for c in range(len(terms) + 1)]
            total = sum(t * (math.factorial(c) * math.factorial(d - 1 - c) / math.factorial(d)) for c, t in enumerate(terms))
            out[:, i] += value * total * (keeps[i] - share[i])
    return out, expected


def explained(rows: DataFrame, model: Boosted, of: int, keys: Sequence[str], top: int = 5) -> DataFrame:
    """keys with chances (by class), margin and expected of class `of`, and drivers: the `top` features that move the row's
    margin most, as (feature, value). The ensemble is as large as the model, whatever the table."""
    spark, n = rows.sparkSession, len(model.features)
    sent = spark.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in rows.select(*keys).schema}
    driver = pa.list_(pa.struct([("feature", pa.string()), ("value", pa.float64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            bins = binned(batch.columns[len(keys) :], m.borders)
            margin = margins(m.start, m.rounds, bins)
            values, expected = np.zeros((len(bins), n)), float(m.start[of])
            for trees in m.rounds:
                part, mean = added_by(trees[of], bins, n)
                values, expected = values + part, expected + mean
            order = np.argsort(-np.abs(values), axis=1, kind="stable")[:, :top]
            drivers = [[{"feature": m.features[f], "value": float(v[f])} for f in o] for o, v in zip(order, values)]
            columns = [*batch.columns[: len(keys)], pa.array(softmax(margin).tolist(), pa.list_(pa.float64())), pa.array(margin[:, of]), pa.array(np.full(len(bins), expected)), pa.array(drivers, driver)]
            yield pa.RecordBatch.from_arrays(columns, [*keys, "chances", "margin", "expected", "drivers"])

    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", chances array<double>, margin double, expected double, drivers array<struct<feature: string, value: double>>"
    return rows.select(*keys, *[F.col(f).cast("double").alias(f"__f{i}") for i, f in enumerate(model.features)]).mapInArrow(task, schema)
