"""Survival curves and censoring-weighted metrics as Spark aggregations.

Curves are computed from counts per (group, time); a window over those counts is as long as the number
of distinct times of a group, not as its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_join
from .ranks import positions, ranged, sum_before


def risk_table(rows: DataFrame, by: Sequence[str], time: str, event: str) -> DataFrame:
    """(by, t, n_risk, d0, d1, d2): rows at risk at each distinct time, and ends of each kind then."""
    counts = rows.groupBy(*by, F.col(time).alias("t")).agg(F.count("*").alias("n"), *[F.count_if(F.col(event) == k).alias(f"d{k}") for k in range(3)])
    later = Window.partitionBy(*by).orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "t", F.sum("n").over(later).alias("n_risk"), "d0", "d1", "d2")


def kaplan_meier(rows: DataFrame, by: Sequence[str], time: str, event: str) -> DataFrame:
    """(by, t, survival): the chance to be free of any event after t."""
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return risk_table(rows, by, time, event).select(*by, "t", F.product(1 - (F.col("d1") + F.col("d2")) / F.col("n_risk")).over(w).alias("survival"))


def censoring_survival(rows: DataFrame, by: Sequence[str], time: str, event: str) -> DataFrame:
    """(by, t, g): the chance to be uncensored after t; events of a time leave the risk set before its censorings."""
    w = Window.partitionBy(*by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    at_risk = F.col("n_risk") - F.col("d1") - F.col("d2")
    return risk_table(rows, by, time, event).select(*by, "t", F.product(1 - F.when(at_risk > 0, F.col("d0") / at_risk).otherwise(0.0)).over(w).alias("g"))


def aalen_johansen(rows: DataFrame, by: Sequence[str], time: str, event: str, cause: int = 1) -> DataFrame:
    """(by, t, cif): cumulative incidence of a cause under competing events."""
    w = Window.partitionBy(*by).orderBy("t")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = risk_table(rows, by, time, event).withColumn("s", F.product(1 - (F.col("d1") + F.col("d2")) / F.col("n_risk")).over(so_far))
    steps = steps.withColumn("before", F.coalesce(F.lag("s").over(w), F.lit(1.0)))
    return steps.select(*by, "t", F.sum(F.col("before") * F.col(f"d{cause}") / F.col("n_risk")).over(so_far).alias("cif"))


def censoring_group(rows: DataFrame, stratum: str, least: int, name: str = "censoring_group") -> DataFrame:
    """The stratum where it has enough rows, else POOLED."""
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    return rows.join(sizes, stratum, "left").withColumn(name, F.when(F.col("__n") >= least, F.col(stratum)).otherwise(F.lit("POOLED"))).drop("__n")


def weighted(rows: DataFrame, by: Sequence[str], time: str, event: str, horizon: Column, name: str = "weight") -> DataFrame:
    """rows with label (event 1 by their horizon) and a weight: 1/G before the event or at the horizon; 0 if censored
    earlier. G is the censoring curve of the rows that share `by`; horizons may differ by row.

    The curves of all groups are taken together and looked up once for each distinct time of a group; rows get the answer
    by equality.
    """
    group = [f"__by{i}" for i in range(len(by))]
    renamed = [F.col(c).alias(g) for c, g in zip(by, group)]
    curve = censoring_survival(rows.select(*renamed, time, event), group, time, event).select(*group, F.col("t").alias("__t"), F.col("g").alias("__g"))
    keyed = rows.withColumn("__horizon", horizon)
    ended = F.coalesce((F.col(time) <= F.col("__horizon")) & (F.col(event) > 0), F.lit(False))
    keyed = keyed.withColumn("__ended", ended).withColumn("__at", F.when(ended, F.col(time)).otherwise(F.col("__horizon")))
    asked = keyed.select(*renamed, "__ended", "__at").distinct()
    before = asof_join(asked.filter("__ended"), curve, group, "__at", "__t", strict=True)
    after = asof_join(asked.filter("not __ended"), curve, group, "__at", "__t")
    answers = before.unionByName(after).select(*group, F.col("__ended").alias("__e"), F.col("__at").alias("__a"), F.coalesce("__g", F.lit(1.0)).alias("__g"))
    same = (F.col("__ended") == F.col("__e")) & (F.col("__at") == F.col("__a"))
    for c, g in zip(by, group):
        same = same & keyed[c].eqNullSafe(F.col(g))
    met = keyed.join(answers, same, "left")
    inside = F.col(time) <= F.col("__horizon")
    weight = F.when(~F.col("__ended") & inside, 0.0).when(F.col("__g") > 0, 1 / F.col("__g"))
    label = F.when(inside & (F.col(event) == 1), 1).otherwise(0)
    return met.withColumn(name, weight).withColumn("label", label).drop("__horizon", "__at", "__ended", "__e", "__a", "__g", *group)


def ipcw(rows: DataFrame, group: str, time: str, event: str, horizon: int) -> DataFrame:
    """rows with label and weight at one horizon, by the curves of one column's groups."""
    return weighted(rows, [group], time, event, F.lit(horizon))


def weighted_auc(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str) -> DataFrame:
    """(by, auc): chance that a positive outranks a negative, ties half, from weights per distinct score."""
    sums = rows.groupBy(*by, score).agg(F.sum(F.col(weight) * F.col(label)).alias("p"), F.sum(F.col(weight) * (1 - F.col(label))).alias("n"))
    ranked = sum_before(sums, by, [score], F.col("n"), "below")
    return ranked.groupBy(*by).agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def weighted_brier(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str) -> DataFrame:
    """(by, brier): weighted squared error over all rows."""
    return rows.groupBy(*by).agg((F.sum(F.col(weight) * F.pow(F.col(label) - F.col(score), 2)) / F.count("*")).alias("brier"))


def top_fraction(rows: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], fraction: float) -> DataFrame:
    """The max(1, ceil(fraction * n)) rows of highest score of each group, ties in the given order."""
    ranked = positions(rows, by, [F.desc(score), *ties], "__r", "__n")
    return ranked.filter(F.col("__r") < F.greatest(F.lit(1), F.ceil(F.col("__n") * fraction))).drop("__r", "__n")


def lift(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str, ties: Sequence[str], fraction: float = 0.1) -> DataFrame:
    """(by, lift): the event rate among the top fraction over that of all; null where either has no weight or no event."""
    rate = F.sum(F.col(weight) * F.col(label)) / F.nullif(F.sum(weight), F.lit(0.0))
    top = top_fraction(rows, by, score, ties, fraction).groupBy(*by).agg(rate.alias("top"))
    return top.join(rows.groupBy(*by).agg(rate.alias("all")), list(by)).select(*by, (F.col("top") / F.nullif(F.col("all"), F.lit(0.0))).alias("lift"))


def equal_bins(rows: DataFrame, by: Sequence[str], score: str, ties: Sequence[str], bins: int) -> DataFrame:
    """rows with bin 1..bins of equal counts by score; the first bins are larger by one where counts don't divide."""
    ranked = positions(rows, by, [score, *ties], "__r", "__n")
    size = F.floor(F.col("__n") / bins)
    larger = F.col("__n") % bins * (size + 1)
    late = F.col("__n") % bins + F.floor((F.col("__r") - larger) / F.greatest(size, F.lit(1)))
    return ranked.withColumn("bin", (F.when(F.col("__r") < larger, F.floor(F.col("__r") / (size + 1))).otherwise(late) + 1).cast("int")).drop("__r", "__n")


def calibration(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str) -> DataFrame:
    """(by, n, predicted, observed): mean score and weighted event rate."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("predicted"), (F.sum(F.col(weight) * F.col(label)) / F.nullif(F.sum(weight), F.lit(0.0))).alias("observed"))


def calibration_slope(rows: DataFrame, score: str, label: str, weight: str, steps: int = 25) -> tuple[float, float]:
    """Intercept and slope of a weighted logistic model of the label on the score's log-odds.

    Damped Newton steps; each is one aggregation of five sums, whatever the number of rows.
    """
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    held = rows.select(F.log(p / (1 - p)).alias("x"), F.col(label).cast("double").alias("y"), F.col(weight).alias("w")).filter("w > 0").persist()
    beta = np.array([0.0, 1.0])
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(F.lit(float(beta[0])) + F.lit(float(beta[1])) * F.col("x"))))
        e, v = F.col("w") * (F.col("y") - q), F.col("w") * q * (1 - q)
        s = held.agg(F.sum(e), F.sum(e * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x"))).first()
        if s[0] is None:
            break
        step = np.linalg.lstsq(np.array([[s[2], s[3]], [s[3], s[4]]]), np.array([s[0], s[1]]), rcond=None)[0]
        beta += step * min(1.0, 2 / max(float(np.abs(step).max()), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    held.unpersist()
    return float(beta[0]), float(beta[1])


#: Rows for which a task makes draws at a time, 1,000 numbers or so for each.
DRAWN = 1_024


def poisson_draws(clusters: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """Times that each cluster (a 64-bit hash) is drawn in each replicate: Poisson(1) by a hash of both."""
    x = clusters[:, None].view(np.uint64) + replicates[None].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    limits = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(limits, (x >> np.uint64(11)) / 2.0**53, "right").astype(float)


def bootstrap_auc(rows: DataFrame, score: str, label: str, weight: str, cluster: str, replicates: int = 1_000, seed: int = 42) -> DataFrame:
    """(replicate, auc): the weighted AUC with all rows of a cluster drawn together, Poisson(1) times.

    Weights are summed per score and cluster and dealt by ranges of scores. A first pass takes each range's sums of all
    replicates, a second the ranks, with the sums of the lower ranges broadcast: ranges times replicates numbers.
    """
    sums = rows.groupBy(F.col(score).alias("score"), F.xxhash64(cluster, F.lit(seed)).alias("cluster")).agg(F.sum(F.col(weight) * F.col(label)).alias("p"), F.sum(F.col(weight) * (1 - F.col(label))).alias("n"))
    held = ranged(sums.select("score", "cluster", F.col("p").cast("double"), F.col("n").cast("double")), [], ["score"]).sortWithinPartitions("score")
    drawn = np.arange(1, replicates + 1)
    lists = pa.list_(pa.float64())

    def per_score(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Sums of all replicates for runs of whole scores, in order: range, positives and negatives by score. Draws are
        made for DRAWN rows at a time; of a score that goes on only its sums are kept."""
        of, last, open_sums = None, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, DRAWN):
                part = batch.slice(at, DRAWN)
                scores = part.column("score").to_numpy()
                starts = np.flatnonzero(np.concatenate([[True], scores[1:] != scores[:-1]]))
                times = poisson_draws(part.column("cluster").to_numpy(), drawn)
                sums = [np.add.reduceat(part.column(c).to_numpy()[:, None] * times, starts) for c in ("p", "n")]
                if last is not None and scores[0] == last:
                    for held, more in zip(sums, open_sums):
                        held[:1] += more
                elif last is not None:
                    yield of, *open_sums
                of, last, open_sums = part.column("__range")[0].as_py(), scores[-1], [held[-1:].copy() for held in sums]
                if len(starts) > 1:
                    yield of, *[held[:-1] for held in sums]
        if last is not None:
            yield of, *open_sums

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = None, 0.0
        for of, _, n in per_score(batches):
            total = total + n.sum(axis=0)
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.array([of], pa.int32()), pa.array([total], lists)], ["range", "n"])

    lower, so_far = {}, np.zeros(replicates)
    for r in sorted(held.mapInArrow(totals, "range int, n array<double>").collect()):
        lower[r["range"]] = so_far
        so_far = so_far + np.array(r["n"])
    shared = rows.sparkSession.sparkContext.broadcast(lower)

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, above, positive, negative = None, 0.0, 0.0, 0.0
        for r, p, n in per_score(batches):
            below = shared.value[r] if below is None else below
            before = below + np.cumsum(n, axis=0) - n
            above = above + (p * (before + n / 2)).sum(axis=0)
            positive, negative = positive + p.sum(axis=0), negative + n.sum(axis=0)
            below = below + n.sum(axis=0)
        if below is not None:
            yield pa.RecordBatch.from_arrays([pa.array(drawn, pa.int32()), *[pa.array(x, pa.float64()) for x in (above, positive, negative)]], ["replicate", "above", "p", "n"])

    each = held.mapInArrow(ranks, "replicate int, above double, p double, n double").groupBy("replicate")
    return each.agg((F.sum("above") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def interval(values: DataFrame, by: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Percentile interval of a statistic over replicates."""
    tail = (1 - level) / 2
    return values.groupBy(*by).agg(F.percentile(value, F.lit(tail)).alias("low"), F.percentile(value, F.lit(1 - tail)).alias("high"))


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, accuracy, kappa) of two labellings, from their confusion counts."""
    cells = rows.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows_, cols = cells.groupBy("a").agg(F.sum("n").alias("r")), cells.groupBy("b").agg(F.sum("n").alias("c"))
    chance = rows_.join(cols, rows_["a"] == cols["b"]).agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    total = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    po, pe = F.col("same") / F.col("n"), F.coalesce("rc", F.lit(0)) / (F.col("n") * F.col("n"))
    return total.crossJoin(chance).select("n", po.alias("accuracy"), ((po - pe) / (1 - pe)).alias("kappa"))  # one row each


def label_scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, precision, recall, f1) of each label, from explode of truth and guess."""
    entry = lambda label, t, g, b: F.struct(label.alias("label"), F.lit(t).alias("t"), F.lit(g).alias("g"), b.alias("b"))
    both = F.when(F.col(truth) == F.col(guess), 1).otherwise(0)
    side = F.explode(F.array(entry(F.col(truth), 1, 0, F.lit(0)), entry(F.col(guess), 0, 1, both)))
    sums = rows.select(side.alias("x")).groupBy("x.label").agg(F.sum("x.t").alias("t"), F.sum("x.g").alias("g"), F.sum("x.b").alias("b"))
    return sums.select("label", (F.col("b") / F.nullif("g", F.lit(0))).alias("precision"), (F.col("b") / F.nullif("t", F.lit(0))).alias("recall"), (2 * F.col("b") / (F.col("t") + F.col("g"))).alias("f1"))


