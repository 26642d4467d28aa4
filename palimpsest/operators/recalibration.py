"""Recalibration of three outcomes, and paired comparison of two scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .survival import bootstrap_auc

FLOOR = 1e-9


@dataclass
class Recalibration:
    """An intercept for each index and one slope, for the odds of stopping and of completing against going on."""

    stop: dict[int, float]
    stop_slope: float
    complete: dict[int, float]
    complete_slope: float

    def odds(self, index: Column, stop: Column, complete: Column) -> tuple[Column, Column]:
        """Both logits; an index that was not seen has no intercept."""
        def intercept(held: dict[int, float]) -> Column:
            return F.coalesce(*[F.when(index == i, F.lit(v)) for i, v in held.items()], F.lit(0.0))

        return intercept(self.stop) + self.stop_slope * stop, intercept(self.complete) + self.complete_slope * complete


def log_odds(rows: DataFrame) -> DataFrame:
    """rows (p_continue, p_stop, p_complete) with x and z, the log-odds of stopping and completing against going on."""
    p = [F.least(F.greatest(F.col(f"p_{n}"), F.lit(FLOOR)), F.lit(1.0)) for n in ("continue", "stop", "complete")]
    return rows.withColumn("x", F.log(p[1]) - F.log(p[0])).withColumn("z", F.log(p[2]) - F.log(p[0]))


def with_chances(rows: DataFrame, fitted: Recalibration, index: str) -> DataFrame:
    """rows (x, z) with q1, q2 and logs, the chances of stopping and completing and the log of all weights."""
    u, v = fitted.odds(F.col(index), F.col("x"), F.col("z"))
    top = F.greatest(F.lit(0.0), F.col("u"), F.col("v"))
    held = rows.withColumns({"u": u, "v": v}).withColumn("logs", top + F.log(F.exp(-top) + F.exp(F.col("u") - top) + F.exp(F.col("v") - top)))
    return held.withColumns({"q1": F.exp(F.col("u") - F.col("logs")), "q2": F.exp(F.col("v") - F.col("logs"))})


def recalibrated(rows: DataFrame, fitted: Recalibration, index: str) -> DataFrame:
    """rows (p_continue, p_stop, p_complete, index) with the three chances replaced."""
    found = with_chances(log_odds(rows), fitted, index)
    new = {"p_continue": 1 - F.col("q1") - F.col("q2"), "p_stop": F.col("q1"), "p_complete": F.col("q2")}
    return found.withColumns(new).select(*rows.columns)


def fit_recalibration(rows: DataFrame, index: str, outcome: str, steps: int = 50) -> Recalibration:
    """Maximum likelihood by damped Newton steps from the identity. rows: three chances, an index and the outcome (1 stop,
    2 completion, else none). Each step is one aggregate per index, so only sums by index reach the driver."""
    held = log_odds(rows).select(F.col(index).alias("index"), "x", "z", F.col(outcome).alias("y")).persist()
    indices = sorted(r["index"] for r in held.select("index").distinct().collect())
    n, size = len(indices), 2 * len(indices) + 2
    one, x, z = F.lit(1.0), F.col("x"), F.col("z")

    def unpacked(theta: np.ndarray) -> Recalibration:
        return Recalibration(dict(zip(indices, theta[:n].tolist())), float(theta[n]), dict(zip(indices, theta[n + 1 : -1].tolist())), float(theta[-1]))

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        q1, q2 = F.col("q1"), F.col("q2")
        g1, g2 = q1 - (F.col("y") == 1).cast("int"), q2 - (F.col("y") == 2).cast("int")
        chosen = F.when(F.col("y") == 1, F.col("u")).when(F.col("y") == 2, F.col("v")).otherwise(0.0)
        w11, w22, w12 = q1 * (1 - q1), q2 * (1 - q2), -q1 * q2
        asked = [F.col("logs") - chosen, g1, g1 * x, g2, g2 * z]
        asked += [w * a for w, pairs in ((w11, (one, x, x * x)), (w22, (one, z, z * z)), (w12, (one, x, z, x * z))) for a in pairs]
        found = with_chances(held, unpacked(theta), "index").groupBy("index").agg(*[F.sum(a).alias(f"s{i}") for i, a in enumerate(asked)]).collect()
        loss, gradient, curve = 0.0, np.zeros(size), np.zeros((size, size))
        for row in found:
            i, s = indices.index(row["index"]), row[1:]
            a, b, c, d = i, n, n + 1 + i, size - 1  # intercept and slope of stopping, then of completing
            loss += s[0]
            np.add.at(gradient, [a, b, c, d], s[1:5])
            for p, q, value in ((a, a, s[5]), (a, b, s[6]), (b, b, s[7]), (c, c, s[8]), (c, d, s[9]), (d, d, s[10]), (a, c, s[11]), (b, c, s[12]), (a, d, s[13]), (b, d, s[14])):
                curve[p, q] += value
                curve[q, p] += value if p != q else 0.0
        return loss, gradient, curve

    theta = np.zeros(size)
    theta[n] = theta[-1] = 1.0
    loss, gradient, curve = sums(theta)
    for _ in range(steps if n else 0):
        step, share = np.linalg.solve(curve + 1e-10 * max(1.0, np.abs(curve).max()) * np.eye(size), gradient), 1.0
        while True:
            tried = sums(theta - share * step)
            if tried[0] <= loss + 1e-12 * abs(loss) or share < 1e-6:
                break
            share /= 2
        gained = loss - tried[0]
        theta, (loss, gradient, curve) = theta - share * step, tried
        if gained < 1e-10 * max(1.0, abs(loss)):
            break
    held.unpersist()
    return unpacked(theta)


def paired_difference(rows: DataFrame, first: str, second: str, label: str, weight: str, cluster: str, replicates: int = 1_000, least_valid: float = 0.95) -> DataFrame:
    """(difference, low, high, valid): the weighted AUC of first less that of second and its 95 % interval, both scores
    judged on the same draws of clusters. Without `least_valid` of the replicates having both there is no interval."""
    a, b = (bootstrap_auc(rows, s, label, weight, cluster, replicates).select("replicate", F.col("auc").alias(n)) for s, n in ((first, "a"), (second, "b")))
    each = a.join(b, "replicate").select((F.col("a") - F.col("b")).alias("d"))
    tails = F.percentile("d", F.array(F.lit(0.025), F.lit(0.975)))  # as many values as replicates
    found = each.agg(F.avg("d").alias("difference"), tails.alias("tails"), F.count("d").alias("valid"))
    enough = F.col("valid") >= math.ceil(least_valid * replicates)
    return found.select("difference", F.when(enough, F.col("tails")[0]).alias("low"), F.when(enough, F.col("tails")[1]).alias("high"), "valid")
