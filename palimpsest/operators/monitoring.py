"""Monitoring of scored predictions: outcomes, grades, drift, gates, alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import percentiles


def outcomes_after(predictions: DataFrame, events: DataFrame, data_date) -> DataFrame:
    """predictions (id, prediction_date) with the first event strictly after it and up to data_date, and time in days.

    events: id, day, event (0 censors). Open rows are censored half a day after the data date.
    """
    later = predictions.select("id", "prediction_date").distinct().join(events, "id").filter((F.col("day") > F.col("prediction_date")) & (F.col("day") <= F.lit(data_date)))
    first = later.groupBy("id", "prediction_date").agg(F.min(F.struct("day", "event")).alias("first"))
    open_days = F.datediff(F.lit(data_date), F.col("prediction_date")) + 0.5
    return predictions.join(first, ["id", "prediction_date"], "left").select(
        *predictions.columns, F.coalesce("first.event", F.lit(0)).alias("event"), F.coalesce(F.datediff("first.day", "prediction_date").cast("double"), open_days).alias("time")
    )


def in_groups(rows: DataFrame, index: str, flag: str) -> DataFrame:
    """Each row in its own group and in the groups of all: index -1, and 'all' beside 'flagged'."""
    groups = F.when(F.col(flag), F.array(F.lit("all"), F.lit("flagged"))).otherwise(F.array(F.lit("all")))
    each = rows.withColumn("group", F.explode(groups))
    return each.withColumn("index_group", F.explode(F.array(F.lit(-1), F.col(index).cast("int"))))


def quantile_edges(rows: DataFrame, column: str, bins: int) -> list[float]:
    """Distinct inner edges of equal-count bins; exact."""
    edges = percentiles(rows, [], column, [i / bins for i in range(1, bins)]).first()
    return sorted({e for e in edges or [] if e is not None})


def binned_shares(rows: DataFrame, column: str, edges: Sequence[float], name: str) -> DataFrame:
    """(bin, name): the share of rows in each bin; nulls are bin -1."""
    number = sum([(F.col(column) > e).cast("int") for e in edges], F.lit(0)) if edges else F.lit(0)
    counts = rows.groupBy(F.when(F.col(column).isNull(), -1).otherwise(number).alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy()
    return counts.select("bin", (F.col("n") / F.sum("n").over(total)).alias(name))


def stability_index(reference: DataFrame, current: DataFrame, column: str, bins: int = 10, least: float = 1e-4) -> DataFrame:
    """(column, psi): sum of (p - q) ln(p / q) over bins of equal reference counts."""
    edges = quantile_edges(reference, column, bins)
    both = binned_shares(reference, column, edges, "p").join(binned_shares(current, column, edges, "q"), "bin", "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(least)) for c in ("p", "q"))
    return both.agg(F.lit(column).alias("column"), F.sum((q - p) * F.log(q / p)).alias("psi"))


def category_stability(reference: DataFrame, current: DataFrame, column: str, least: float = 1e-4) -> DataFrame:
    def shares(rows, name):
        return rows.groupBy(column).agg(F.count("*").alias("n")).select(column, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias(name))

    b = shares(current, "q").withColumnRenamed(column, "__c")
    both = shares(reference, "p").join(b, F.col(column).eqNullSafe(F.col("__c")), "full")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(least)) for c in ("p", "q"))
    return both.agg(F.lit(column).alias("column"), F.sum((q - p) * F.log(q / p)).alias("psi"))


def promote(champion_auc: float | None, challenger_auc: float | None, slope: float | None, margin: float = 0.005, slopes: tuple[float, float] = (0.8, 1.2)) -> bool:
    """Whether a challenger may replace the champion; not without all figures."""
    if champion_auc is None or challenger_auc is None or slope is None:
        return False
    return challenger_auc >= champion_auc - margin and slopes[0] <= slope <= slopes[1]


def alerts(data_date, last_post, quarantined: int, rows: int, drifted: int, features: int, auc: float | None, lag_days: int = 5, share: float = 0.01, drift: float = 0.3, floor: float = 0.65) -> list[str]:
    found = [
        ("lag", last_post is None or (data_date - last_post).days > lag_days),
        ("quarantine", rows > 0 and quarantined / rows > share),
        ("drift", features > 0 and drifted / features > drift),
        ("auc", auc is not None and auc < floor),
    ]
    return [name for name, raised in found if raised]


def replay_outcomes(scored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """scored rows (trial_id, day, ...) with the event, event_date and time in days that followed: trials without an outcome,
    ended by the day, or opened again after their end are left out."""
    known = outcomes.filter("not reversal").select("trial_id", "event", "event_date")
    met = scored.join(known, "trial_id").filter(F.col("event_date") > F.col("day"))
    return met.withColumn("time", F.datediff("event_date", "day"))
