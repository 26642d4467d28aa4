"""Proportional hazards against a dense fit."""

import numpy as np
import pytest
from palimpsest.operators import cox
from pyspark.sql import functions as F


def table(n=600, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 2)) + [3.0, -1.0]
    s = r.integers(0, 2, n)
    t = np.ceil(20 * r.exponential(1 / np.exp(0.8 * (x[:, 0] - 3) - 0.5 * (x[:, 1] + 1) + s)))
    other = np.ceil(30 * r.exponential(size=n))
    event = np.where(t <= other, 1, np.where(r.random(n) < 0.5, 2, 0))
    return np.minimum(t, other), event, x, s


def dense(t, event, x, s):
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        value, g, h = 0.0, np.zeros_like(beta), np.zeros((len(beta),) * 2)
        for k in np.unique(s):
            m = s == k
            for at in np.unique(t[m & (event == 1)]):
                ends, risk = m & (t == at) & (event == 1), m & (t >= at)
                w = np.exp(x[risk] @ beta)
                mean = w @ x[risk] / w.sum()
                value += (x[ends] @ beta).sum() - ends.sum() * np.log(w.sum())
                g += (x[ends] - mean).sum(axis=0)
                h += ends.sum() * ((x[risk].T * w) @ x[risk] / w.sum() - np.outer(mean, mean))
        beta = beta + np.linalg.solve(h, g)
    return beta, np.linalg.inv(h), value


@pytest.fixture(scope="module")
def data(spark):
    t, event, x, s = table()
    rows = [(float(a), int(e), float(u), float(v), int(k)) for a, e, (u, v), k in zip(t, event, x, s)]
    frame = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 1), (5.0, 1, None, 0.0, 1)], "t double, event int, u double, v double, s int")
    return frame.repartition(5), (t, event, x, s)


@pytest.mark.parametrize("strata", [[], ["s"]])
def test_fit_equals_a_dense_one(data, strata):
    frame, (t, event, x, s) = data
    found = cox.fit(frame, "t", F.col("event") == 1, ["u", "v"], strata)
    beta, covariance, _ = dense(t, event, x - x.mean(axis=0), s if strata else np.zeros(len(t)))
    assert found.beta == pytest.approx(beta, abs=1e-6) and found.covariance == pytest.approx(covariance, rel=1e-5)
    assert found.steps < 12


def test_baseline_and_proportionality(data):
    frame, (t, event, x, s) = data
    model = cox.fit(frame, "t", F.col("event") == 1, ["u", "v"])
    rows = cox.baseline(frame, model, "t", F.col("event") == 1).orderBy("t").collect()
    w = np.exp(x @ model.beta)
    want = np.cumsum([((t == at) & (event == 1)).sum() / w[t >= at].sum() for at in np.unique(t[event == 1])])
    assert [r.cumulative for r in rows] == pytest.approx(want.tolist(), rel=1e-9)
    steady = {r.feature: r.chi2 for r in cox.proportionality(frame, model, "t", F.col("event") == 1).collect()}
    r = np.random.default_rng(7)  # a feature whose effect turns around with time
    z = r.integers(0, 2, 900)
    at = np.where(z == 1, r.uniform(0, 10, 900), np.where(r.random(900) < 0.5, r.uniform(0, 1, 900), r.uniform(9, 12, 900)))
    turning = frame.sparkSession.createDataFrame([(float(np.ceil(a * 10)), 1, float(k)) for a, k in zip(at, z)], "t double, event int, z double")
    drift = cox.proportionality(turning, cox.fit(turning, "t", F.col("event") == 1, ["z"]), "t", F.col("event") == 1).first()
    assert max(steady.values()) < 8 and drift.chi2 > 15
