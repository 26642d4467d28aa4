"""Boosted trees: held-out loss, early stopping, attributions against all subsets."""

import math
from itertools import combinations

import numpy as np
import pytest
from palimpsest.operators import boosting as b
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

FEATURES = ["x0", "x1", "x2", "x3"]


def table(n, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 4))
    score = np.stack([np.zeros(n), 2.5 * (x[:, 0] * x[:, 1] > 0) - 1, 2.0 * np.abs(x[:, 2]) - 1.5], axis=1)
    y = (score + r.gumbel(size=(n, 3))).argmax(axis=1)
    rows = [(i, int(k), *(None if (i + j) % 37 == 0 else float(v) for j, v in enumerate(row)), i % 4 == 0) for i, (k, row) in enumerate(zip(y, x))]
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(4_000, 1), "id long, y int, x0 double, x1 double, x2 double, x3 double, held boolean").repartition(3)


@pytest.fixture(scope="module")
def model(rows):
    return b.fit(rows, FEATURES, "y", 3, validation="held", rounds=20, depth=3, rate=0.3)


def loss(rows, chance):
    return rows.agg(F.avg(-F.log(chance))).first()[0]


def test_held_out_loss_is_below_a_linear_models(rows, model):
    found = b.explained(rows.filter("held"), model, 1, ["id", "y"])
    assert all(abs(sum(r.chances) - 1) < 1e-9 for r in found.limit(20).collect())
    boosted = loss(found, F.get("chances", F.col("y")))
    assert boosted == pytest.approx(model.losses[len(model.rounds)] if len(model.rounds) < len(model.losses) else boosted, rel=1e-6)
    dense = VectorAssembler(inputCols=FEATURES, outputCol="f").transform(rows.fillna(0.0))
    linear = LogisticRegression(featuresCol="f", labelCol="y", family="multinomial").fit(dense.filter("not held")).transform(dense.filter("held"))
    assert boosted < loss(linear, F.get(vector_to_array("probability"), F.col("y"))) - 0.05
    assert model.losses[0] > min(model.losses)


def test_it_stops_early_and_keeps_the_best_rounds(spark):
    r = np.random.default_rng(2)
    noise = spark.createDataFrame([(int(k), float(x), i % 2 == 0) for i, (k, x) in enumerate(zip(r.integers(0, 3, 300), r.normal(size=300)))], "y int, x double, held boolean")
    found = b.fit(noise, ["x"], "y", 3, validation="held", rounds=30, depth=2, patience=3)
    assert len(found.losses) < 30 and len(found.rounds) == int(np.argmin(found.losses))


def brute(tree, row, n):
    """Shapley values over all subsets of the path-dependent expectation."""

    def value(known, node=0, level=0):
        if level == tree.depth:
            return tree.value[node]
        at = node + (1 << level) - 1
        f = tree.feature[at]
        if f < 0:
            return value(known, 2 * node, level + 1)
        if f in known:
            return value(known, 2 * node + (row[f] > tree.last[at]), level + 1)
        shares = [tree.cover[2 * node + s + (2 << level) - 1] / tree.cover[at] for s in (0, 1)]
        return sum(p * value(known, 2 * node + s, level + 1) for s, p in enumerate(shares))

    out = np.zeros(n)
    for i in range(n):
        others = [j for j in range(n) if j != i]
        for size in range(n):
            for known in combinations(others, size):
                out[i] += math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n) * (value({*known, i}) - value(set(known)))
    return out, value(set())


def test_attributions_equal_all_subsets_and_add_up(rows, model):
    some = rows.orderBy("id").limit(40)
    x = [[r[f] for f in FEATURES] for r in some.collect()]
    import pyarrow as pa

    bins = b.binned([pa.array([r[i] for r in x], pa.float64()) for i in range(4)], model.borders)
    for trees in model.rounds[:3]:
        for tree in trees:
            got, mean = b.added_by(tree, bins, 4)
            for row, values in zip(bins[:8], got):
                want, expected = brute(tree, row, 4)
                assert values == pytest.approx(want, abs=1e-9) and mean == pytest.approx(expected, abs=1e-9)
    for r in b.explained(some, model, 2, ["id"], top=4).collect():
        assert r.expected + sum(d.value for d in r.drivers) == pytest.approx(r.margin, abs=1e-9)
        assert [abs(d.value) for d in r.drivers] == sorted((abs(d.value) for d in r.drivers), reverse=True)
