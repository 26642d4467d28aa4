import math

import numpy as np
import pytest

from palimpsest.llm import hard_negatives as m


def plain(rows, anchors, n_pos=5, n_neg=3, low=50, high=95):
    """From the definition, over all pairs."""
    held = []
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        held.append((i, label, tuple(math.floor(256 * c) for c in x)))
    held, out = [min(h for h in held if h[0] == i) for i in sorted({h[0] for h in held})], []
    for i, label, a in held:
        if not anchors(i):
            continue
        scored = [(-sum(p * q for p, q in zip(a, b)), j, other == label) for j, other, b in held if j != i and len(b) == len(a)]
        for p, j, _ in sorted(s for s in scored if s[2])[:n_pos]:
            inside = sorted((s, k) for s, k, same in scored if not same and low * -p <= -100 * s <= high * -p)
            out += [(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(inside[:n_neg], 1)]
    return sorted(out)


def found(frame, anchors, **more):
    return sorted(tuple(r) for r in m.mine(frame, anchors, **more).collect())


def vectors(seed, n, dims=12, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(9, dims))
    x = centres[r.integers(0, 9, n)] + r.normal(size=(n, dims)) * 0.6
    x[n // 2 : n // 2 + 25] = x[3]  # ties
    return [(i, int(k), [float(c) for c in row]) for i, k, row in zip(range(n), r.integers(0, labels, n), x)]


SCHEMA = "vec_id long, label int, embedding array<float>"


def as_read(rows):
    return [(i, label, x and [c if c is None else float(np.float32(c)) for c in x]) for i, label, x in rows]


@pytest.mark.parametrize("block,anchors_at_once", [(8_192, 2_048), (60, 7)])
def test_equals_scoring_everything(spark, monkeypatch, block, anchors_at_once):
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "ANCHORS", anchors_at_once)
    rows = vectors(block, 400)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = plain(as_read(rows), lambda i: i % 9 == 0)
    assert expected and found(frame, lambda c: c % 9 == 0) == expected


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(2, 60, dims=5) + [(100, None, [1.0] * 5), (101, 1, None), (102, 1, [1.0, None, 0.0, 0.0, 0.0]), (103, 1, [nan] * 5), (104, 2, [inf] * 5), (None, 1, [1.0] * 5)]
    rows += [rows[3], rows[4], (3, 2, [0.5] * 5), (9, 9, [0.25] * 5), (200, 1, [1.0, 2.0]), (201, 1, [1.0, 2.5]), (202, 0, [1.0, 1.5]), (210, 1, []), (211, 1, []), (212, 2, []), (220, 7, [0.0] * 5), (221, 7, [0.0] * 5)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", rank string, positives int, anchor_id int").repartition(2)
    expected = plain(as_read(rows), lambda i: i % 3 == 0 or i >= 200)
    assert found(frame, lambda c: (c % 3 == 0) | (c >= 200)) == expected
    assert any(r[0] == 210 for r in expected)


def test_large_numbers_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(i, i % 3, [float(c) for c in r.integers(-30_000, 30_000, 6)]) for i in range(80)]
    assert found(spark.createDataFrame(rows, SCHEMA), lambda c: c % 5 == 0) == plain(as_read(rows), lambda i: i % 5 == 0)


def test_no_rows(spark):
    for frame in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, [1.0])], SCHEMA)):
        out = m.mine(frame, lambda c: c % 50 == 0)
        assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0


def test_bounds_hold_and_few_rows_are_scored():
    rows = vectors(5, 3_000, dims=32, labels=6)
    v = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    q = np.quantile(v, np.linspace(0, 1, 33)[1:-1], axis=0).T.astype(np.int64)
    edges = np.stack([np.sort([*np.linspace(c.min(), c.max() + 1, 34).astype(np.int64), *e]) for c, e in zip(v.T, q)])
    least, most = m.bounds(m.approximated(v, edges), *m.tables(v[:8], edges))
    score = v @ v[:8].T
    assert (least <= score).all() and (score <= most).all()
    asked = []

    def exact(rows):
        asked.append(len(rows))
        return score[rows, 0]

    ids = np.arange(len(v))
    got = m.best_positives(least[:, 0], most[:, 0], exact, ids, 5)[0]
    assert got.tolist() == np.lexsort((ids, -score[:, 0]))[:5].tolist()
    m.best_negatives(least[:, 0], most[:, 0], exact, ids, (int(score[:, 0].max()) // 4, int(score[:, 0].max()) // 2), 3)
    assert max(asked) < 0.2 * len(v)
