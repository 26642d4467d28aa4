import numpy as np
import pytest
from palimpsest.llm import neighbours
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=16).tolist(), 1) for i in range(700)]
    rows += [(1_000 + i, rows[3][1], 0) for i in range(40)] + [(2_000, [2 * x for x in rows[3][1]], 0)]
    rows += [(3_000, None, 0), (3_001, [], 0), (3_002, [0.0] * 16, 0), (3_003, [float("nan")] * 16, 0), (3_004, [None] + [1.0] * 15, 0), (3_005, [float("inf")] * 16, 0), (None, rows[4][1], 0), (50, rows[50][1], 2)]
    rows += [(4_000 + i, [1.0, float(i)], 0) for i in range(3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)


def brute(vectors, k=5):
    rows = sorted({(r.vec_id, tuple(r.embedding)) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)})
    out = {}
    for q, x in rows:
        if q % 50 == 0:
            near = [(-np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y), i) for i, y in rows if i != q and len(y) == len(x)]
            out[q] = sorted((round(s, 9), i) for s, i in near)[:k]
    return out


def as_lists(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((round(-r.score, 9), r.vec_id))
    return got


def test_exact_when_all_are_reranked(vectors, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 30)
    monkeypatch.setattr(neighbours, "QUERIES", 4)
    clashing = vectors.withColumns({"class": F.lit("c"), "ids": F.lit(1), "cell": F.lit(2), "score": F.lit(3), "n": F.lit(4)})
    assert as_lists(neighbours.nearest(clashing, lambda i: i % 50 == 0, recall=1.0).collect()) == brute(vectors)


def test_recall(vectors):
    want, got = brute(vectors), as_lists(neighbours.nearest(vectors, lambda i: i % 50 == 0).collect())
    assert sum(len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want) / sum(map(len, want.values())) >= 0.95
    assert all(v == sorted(v) for v in got.values())


def test_ties_go_to_the_smaller_id(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(0, x), *[(i, y) for i in (9, 3, 7)], *[(i, z) for i in (8, 2, 4)], (5, x), (5, x)]
    got = as_lists(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 50 == 0).collect())
    assert got == {0: [(-1.0, 5), (0.0, 2), (0.0, 3), (0.0, 4), (0.0, 7)]}


def test_the_index_prunes():
    r = np.random.default_rng(3)
    data = np.repeat(r.normal(size=(40, 24)), 60, axis=0) + 0.2 * r.normal(size=(2_400, 24))
    probes, near = neighbours.calibrate(data, data[r.choice(2_400, 256, replace=False)], 5, 0.98)
    held = neighbours.weights(neighbours.units(data), neighbours.units(data[:256]))
    assert probes <= neighbours.CELLS // 4 and near > 0 and (neighbours.nearness(held, held[:50]) >= near).mean() < 0.2


def test_few_and_none(spark, vectors):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(few, lambda i: i % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(few.limit(0), lambda i: i % 50 == 0).count() == 0
    assert neighbours.nearest(few, lambda i: F.lit(False)).count() == 0
