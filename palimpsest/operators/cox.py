"""Cause-specific proportional hazards: events of one cause, all others censored, ties by Breslow's rule.

A Newton step needs, at each distinct event time of a stratum, sums over the rows still at risk. Rows are first summed by
(stratum, time); running sums from the latest time down go by ranges of the order (`ranks.sum_before`), so that no task holds a
stratum. Only the gradient and the curvature, as large as the number of features, reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .ranks import ranged, sum_before


class Cox(NamedTuple):
    features: list[str]
    beta: np.ndarray
    covariance: np.ndarray
    log_likelihood: float
    steps: int


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def risk_sums(rows: DataFrame, strata: Sequence[str], time: str, event: Column, features: Sequence[str], beta: np.ndarray) -> DataFrame:
    """Per (strata, t) with an event: d events, their sum of the log risk and of features, and over the rows at risk sums of the risk
    (s0), of risk times features (s1_i) and of risk times products of features (s2_i_j)."""
    p = len(features)
    linear = reduce(lambda a, c: a + c, (F.lit(float(b)) * F.col(f) for b, f in zip(beta, features)), F.lit(0.0))
    risk, ended = F.exp(linear), F.when(event, 1.0).otherwise(0.0)
    at_time = {"d": ended, "e": ended * linear, **{f"x_{i}": ended * F.col(f) for i, f in enumerate(features)}}
    running = {"s0": risk, **{f"s1_{i}": risk * F.col(f) for i, f in enumerate(features)}, **{f"s2_{i}_{j}": risk * F.col(features[i]) * F.col(features[j]) for i, j in _pairs(p)}}
    sums = rows.groupBy(*strata, F.col(time).alias("t")).agg(*[F.sum(c).alias(n) for n, c in (at_time | running).items()])
    held = ranged(sums, strata, [F.desc("t")])
    totals = held.groupBy(*strata, "__range").agg(*[F.sum(n).alias(f"__{n}") for n in running])
    earlier = Window.partitionBy(*strata).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*[F.col(c).alias(f"__by_{c}") for c in strata], F.col("__range").alias("__of"), *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0.0)).alias(f"__{n}") for n in running])
    same = reduce(lambda a, c: a & held[c].eqNullSafe(F.col(f"__by_{c}")), strata, F.col("__range") == F.col("__of"))
    inside = Window.partitionBy(*strata, "__range").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    met = held.join(carried, same)
    return met.select(*strata, "t", *at_time, *[(F.sum(n).over(inside) + F.col(f"__{n}")).alias(n) for n in running]).filter("d > 0")


def fit(rows: DataFrame, time: str, cause: Column, features: Sequence[str], strata: Sequence[str] = (), steps: int = 20, ridge: float = 0.0) -> Cox:
    """Breslow's likelihood, by damped Newton steps. cause: whether a row ends by the cause; rows with a null feature, time or
    cause are left out."""
    p = len(features)
    held = rows.select(*strata, F.col(time).cast("double").alias("__time"), cause.alias("__event"), *[F.col(f).cast("double").alias(f) for f in features]).dropna(subset=["__time", "__event", *features])
    means = held.agg(*[F.avg(f) for f in features]).first()
    centred = [m or 0.0 for m in means]
    held = stored(held.select(*strata, "__time", "__event", *[(F.col(f) - F.lit(m)).alias(f) for f, m in zip(features, centred)]))
    beta, before = np.zeros(p), -np.inf
    for step in range(1, steps + 1):
        likelihood, gradient, curvature = _newton(risk_sums(held, strata, "__time", F.col("__event"), features, beta), p)
        likelihood -= ridge * float(beta @ beta) / 2
        gradient, curvature = gradient - ridge * beta, curvature + ridge * np.eye(p)
        move = np.linalg.lstsq(curvature, gradient, rcond=None)[0]
        if likelihood < before - 1e-9:  # the last step went too far
            beta, last = beta - last / 2, last / 2
            continue
        before, last = likelihood, move * min(1.0, 2 / max(float(np.abs(move).max(initial=0.0)), 1e-12))
        if np.abs(move).max(initial=0.0) < 1e-8:
            break
        beta = beta + last
    return Cox(list(features), beta, np.linalg.pinv(curvature), float(before), step)


def _newton(sums: DataFrame, p: int) -> tuple[float, np.ndarray, np.ndarray]:
    s0 = F.col("s0")
    parts = [F.sum(F.col("e") - F.col("d") * F.log(s0))]
    parts += [F.sum(F.col(f"x_{i}") - F.col("d") * F.col(f"s1_{i}") / s0) for i in range(p)]
    parts += [F.sum(F.col("d") * (F.col(f"s2_{i}_{j}") / s0 - F.col(f"s1_{i}") * F.col(f"s1_{j}") / (s0 * s0))) for i, j in _pairs(p)]
    found = [x or 0.0 for x in sums.agg(*[c.alias(f"c{i}") for i, c in enumerate(parts)]).first()]
    curvature = np.zeros((p, p))
    for (i, j), value in zip(_pairs(p), found[1 + p :]):
        curvature[i, j] = curvature[j, i] = value
    return found[0], np.array(found[1 : 1 + p]), curvature


def baseline(rows: DataFrame, model: Cox, time: str, cause: Column, strata: Sequence[str] = ()) -> DataFrame:
    """(strata, t, hazard, cumulative): Breslow's baseline hazard of the cause at features of zero."""
    held = rows.select(*strata, F.col(time).cast("double").alias("__time"), cause.alias("__event"), *[F.col(f).cast("double").alias(f) for f in model.features]).dropna(subset=["__time", "__event", *model.features])
    steps = risk_sums(held, strata, "__time", F.col("__event"), model.features, model.beta).select(*strata, "t", (F.col("d") / F.col("s0")).alias("hazard"))
    return steps.withColumn("cumulative", F.sum("hazard").over(Window.partitionBy(*strata).orderBy("t")))


def proportionality(rows: DataFrame, model: Cox, time: str, cause: Column, strata: Sequence[str] = ()) -> DataFrame:
    """(feature, correlation, chi2, n): whether scaled Schoenfeld residuals drift with the rank of time; chi2 has one degree of freedom.

    A residual is an event's features less their risk-weighted mean among the rows at risk; at tied times the mean one stands
    for all.
    """
    p = len(model.features)
    held = rows.select(*strata, F.col(time).cast("double").alias("__time"), cause.alias("__event"), *[F.col(f).cast("double").alias(f) for f in model.features]).dropna(subset=["__time", "__event", *model.features])
    sums = stored(risk_sums(held, strata, "__time", F.col("__event"), model.features, model.beta))
    n = sums.agg(F.sum("d")).first()[0] or 0.0
    raw = [F.col(f"x_{i}") / F.col("d") - F.col(f"s1_{i}") / F.col("s0") for i in range(p)]
    scaled = [n * reduce(lambda a, c: a + c, (F.lit(float(model.covariance[i, j])) * raw[j] for j in range(p))) for i in range(p)]
    times = sums.groupBy("t").agg(F.sum("d").alias("n_t"))
    ranked = sum_before(times, [], ["t"], F.col("n_t"), "__before").select(F.col("t").alias("__t"), (F.col("__before") + (F.col("n_t") + 1) / 2).alias("g"))
    each = stored(sums.select("t", "d", *[s.alias(f"r_{i}") for i, s in enumerate(scaled)]).join(ranked, F.col("t") == F.col("__t")))
    mean = (n + 1) / 2
    spread = each.agg(F.sum(F.col("d") * F.pow(F.col("g") - mean, 2))).first()[0] or 0.0
    found = each.agg(*[F.sum(F.col("d") * (F.col("g") - mean) * F.col(f"r_{i}")).alias(f"c{i}") for i in range(p)], *[F.sum(F.col("d") * F.pow(F.col(f"r_{i}"), 2)).alias(f"v{i}") for i in range(p)], *[F.sum(F.col("d") * F.col(f"r_{i}")).alias(f"m{i}") for i in range(p)]).first()
    out = []
    for i, f in enumerate(model.features):
        cross, square, mass = (float(found[k] or 0.0) for k in (i, p + i, 2 * p + i))
        variance = max(square - mass * mass / max(n, 1), 1e-300)
        chi2 = cross**2 / (n * float(model.covariance[i, i]) * spread) if spread > 0 and model.covariance[i, i] > 0 else 0.0
        out.append((f, cross / float(np.sqrt(spread * variance)) if spread > 0 else 0.0, chi2, int(n)))
    return rows.sparkSession.createDataFrame(out, "feature string, correlation double, chi2 double, n long")
