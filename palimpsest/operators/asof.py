"""As-of joins: the latest state of an entity on or before (or strictly before) a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(keys: DataFrame, states: DataFrame, by: Sequence[str], key_date: str, state_date: str, how: str = "left", strict: bool = False) -> DataFrame:
    """Each row of keys with the columns of its latest state; one shuffle by the entity, no row is multiplied.

    Keys and states are laid on one timeline per entity and each key takes the last state before it.
    States of one day and entity should be distinct; of several, any may be taken.
    """
    payload = [c for c in states.columns if c not in by]
    clash = set(payload) & set(keys.columns)
    if clash:
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    side_of_state = 1 if strict else 0
    left = keys.select(*by, F.struct(*[c for c in keys.columns if c not in by]).alias("__key"), F.col(key_date).alias("__at"), F.lit(1 - side_of_state).alias("__side"))
    right = states.select(*by, F.struct(*payload).alias("__state"), F.col(state_date).alias("__at"), F.lit(side_of_state).alias("__side"))
    timeline = left.unionByName(right, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    met = timeline.withColumn("__state", F.last("__state", ignorenulls=True).over(before)).filter(F.col("__key").isNotNull())
    if how == "inner":
        met = met.filter(F.col("__state").isNotNull())
    return met.select(*by, "__key.*", "__state.*").select(*keys.columns, *payload)


def asof_value(keys: DataFrame, timeline: DataFrame, key_date: str, timeline_date: str, value: str) -> DataFrame:
    """keys with the last value of a single timeline (a row per date at most) on or before their date.

    Only distinct dates are laid on the timeline, so the one ordered partition is as long as the calendar.
    """
    dates = keys.select(F.col(key_date).alias("__at")).distinct().withColumn("__v", F.lit(None).cast(timeline.schema[value].dataType)).withColumn("__side", F.lit(1))
    values = timeline.select(F.col(timeline_date).alias("__at"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    before = Window.orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    known = dates.unionByName(values).withColumn("__v", F.last("__v", ignorenulls=True).over(before)).filter("__side = 1")
    return keys.join(F.broadcast(known.select(F.col("__at").alias(key_date), F.col("__v").alias(value))), key_date, "left")  # as long as the calendar
