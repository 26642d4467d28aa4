"""Walk-forward evaluation: what a model fitted at each origin is worth afterwards, for all origins, horizons and slices in
one frame.

Rows are laid out once by (origin, months, slice): a slice is one landmark index, or all of them (null). Groups of
censoring are decided on all evaluation rows of an origin, curves are fitted on the rows of a slice, and every metric is
one grouped aggregation, however many origins there are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import survival

SLICE = ["origin", "months", "slice"]
#: rows known at an origin -> a function that adds score_<months> to evaluation rows of that origin.
Fit = Callable[[date], Callable[[DataFrame], DataFrame]]


def evaluated(rows: DataFrame, origins: Sequence[date], window_months: int = 12) -> DataFrame:
    """rows (landmark_date, event_date, ...) with time, once for each origin in whose window they lie."""
    day = F.col("landmark_date")
    within = F.filter(F.array(*map(F.lit, origins)), lambda o: (o <= day) & (day < F.add_months(o, window_months)))
    return rows.select("*", F.datediff("event_date", "landmark_date").alias("time"), F.explode(within).alias("origin"))


def grouped(rows: DataFrame, stratum: str, least: int) -> DataFrame:
    """rows with censoring_group: the stratum where the origin has enough rows of it, else POOLED."""
    sizes = rows.groupBy("origin", F.col(stratum).alias("__stratum")).agg(F.count("*").alias("__n"))
    met = rows.join(sizes.withColumnRenamed("origin", "__origin"), (F.col("origin") == F.col("__origin")) & F.col(stratum).eqNullSafe(F.col("__stratum")))
    return met.withColumn("censoring_group", F.when(F.col("__n") >= least, F.col(stratum)).otherwise(F.lit("POOLED"))).drop("__n", "__origin", "__stratum")


def long_frame(rows: DataFrame, months: Sequence[int]) -> DataFrame:
    """rows with score_<months> laid out by months and slice, with their score and horizon in days."""
    horizons = F.array(*[F.struct(F.lit(m).alias("months"), F.col(f"score_{m}").alias("score"), F.datediff(F.add_months("landmark_date", m), "landmark_date").alias("horizon")) for m in months])
    each = rows.withColumn("__h", F.explode(horizons)).drop(*[f"score_{m}" for m in months])
    slices = F.explode(F.array(F.lit(None).cast("int"), F.col("landmark_index").cast("int"))).alias("slice")
    return each.select(*[c for c in each.columns if c != "__h"], "__h.*", slices)


def metrics(rows: DataFrame, fraction: float = 0.1, weight: str = "weight") -> DataFrame:
    """(origin, months, slice, n_rows, n_trials, auc, brier, lift) of weighted rows."""
    counts = rows.groupBy(*SLICE).agg(F.count("*").alias("n_rows"), F.countDistinct("trial_id").alias("n_trials"))
    held = rows.withColumn("slice", F.coalesce("slice", F.lit(-1)))
    parts = [
        survival.weighted_auc(held, SLICE, "score", "label", weight),
        survival.weighted_brier(held, SLICE, "score", "label", weight),
        survival.lift(held, SLICE, "score", "label", weight, ["trial_id", "landmark_index"], fraction),
    ]
    out = reduce(lambda a, b: a.join(b, SLICE, "left"), parts, counts.withColumn("slice", F.coalesce("slice", F.lit(-1))))
    return out.withColumn("slice", F.when(F.col("slice") >= 0, F.col("slice")))


def run(rows: DataFrame, origins: Sequence[date], months: Sequence[int], fit: Fit, stratum: str = "stratum", window_months: int = 12, least: int = 100, fraction: float = 0.1) -> DataFrame:
    """metrics, and single_<metric> by one censoring curve for all rows, of each origin, horizon and slice.

    rows: landmark rows (trial_id, landmark_index, landmark_date, event, event_date, stratum); fit(origin) may read only
    what was known then.
    """
    held = stored(grouped(stored(evaluated(rows, origins, window_months)), stratum, least))
    scored = reduce(DataFrame.unionByName, [fit(origin)(held.filter(F.col("origin") == F.lit(origin))) for origin in origins])
    laid = stored(long_frame(scored, months))
    by_group = survival.weighted(laid, ["origin", "slice", "censoring_group"], "time", "event", F.col("horizon"))
    both = stored(survival.weighted(by_group.drop("label"), ["origin", "slice"], "time", "event", F.col("horizon"), "single"))
    single = metrics(both, fraction, "single").select(*SLICE, *[F.col(c).alias(f"single_{c}") for c in ("auc", "brier", "lift")])
    named = [F.col(c).alias(f"__{c}") for c in SLICE]
    met = metrics(both, fraction).join(single.select(*named, "single_auc", "single_brier", "single_lift"), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SLICE]))
    return met.drop(*[f"__{c}" for c in SLICE])


def calibration_slopes(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str, steps: int = 25) -> DataFrame:
    """(by, intercept, slope) of weighted logistic models of the label on the score's log-odds, one for each group.

    Damped Newton steps of all groups at once: an aggregation gives five sums a group, which are all that reaches the driver,
    and the next coefficients return by broadcast, a row a group. Groups whose steps have ended keep theirs.
    """
    spark, p = rows.sparkSession, F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    held = stored(rows.filter(F.col(weight) > 0).select(*by, F.log(p / (1 - p)).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).alias("w")))
    groups = [tuple(r) for r in held.select(*by).distinct().collect()]
    beta, open_ = {g: np.array([0.0, 1.0]) for g in groups}, set(groups)
    key = F.struct(*by)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.select(*by).schema)
    for _ in range(steps):
        if not open_:
            break
        now = spark.createDataFrame([(g, float(beta[g][0]), float(beta[g][1])) for g in sorted(open_, key=str)], f"__g struct<{fields.replace('` ', '`: ')}>, __a double, __b double")
        met = held.join(F.broadcast(now), key.eqNullSafe(F.col("__g")))
        q = 1 / (1 + F.exp(-(F.col("__a") + F.col("__b") * F.col("x"))))
        e, v = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
        for *g, e0, e1, v0, v1, v2 in met.groupBy(*by).agg(F.sum(e), F.sum(e * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x"))).collect():
            step = np.linalg.lstsq(np.array([[v0, v1], [v1, v2]]), np.array([e0, e1]), rcond=None)[0]
            beta[tuple(g)] += step * min(1.0, 2 / max(float(np.abs(step).max()), 1e-12))
            if np.abs(step).max() < 1e-9:
                open_.discard(tuple(g))
    return spark.createDataFrame([(*g, float(b[0]), float(b[1])) for g, b in beta.items()], f"{fields}, intercept double, slope double")
