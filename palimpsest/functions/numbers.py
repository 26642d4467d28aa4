"""Number expressions of the evaluation and feature code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.log(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson score interval of k of n."""
    p, z2 = k / n, z * z
    centre, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return (centre - half) / (1 + z2 / n), (centre + half) / (1 + z2 / n)


def cif_from_hazards(hazards: Column) -> Column:
    """From an array of (stop, complete) interval hazards, the cumulative incidence of stop after each."""
    start = F.struct(F.lit(1.0).alias("alive"), F.lit(0.0).alias("stopped"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        stopped = s["stopped"] + s["alive"] * h["stop"]
        return F.struct((s["alive"] * (1 - h["stop"] - h["complete"])).alias("alive"), stopped.alias("stopped"), F.concat(s["out"], F.array(stopped)).alias("out"))

    return F.aggregate(hazards, start, step, lambda s: s["out"])
