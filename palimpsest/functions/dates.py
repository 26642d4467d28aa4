"""Date expressions: clamped months, partial dates, landmark indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(day: Column) -> Column:
    """Months since year 0; the difference of two counts the month boundaries between them."""
    return F.year(day) * 12 + F.month(day)


def months_between(later: Column, earlier: Column) -> Column:
    return month_index(later) - month_index(earlier)


def valid_date(day: Column, first_year: int = 1901, before_year: int = 2100) -> Column:
    """The date, or null where it is a placeholder outside the years."""
    return F.when((F.year(day) >= first_year) & (F.year(day) < before_year), day)


def partial_date(text: Column) -> Column:
    """struct(day, precision) of '2019', '2019-03' or '2019-03-14'; nulls for anything else."""
    shapes = ((r"^\d{4}$", "-01-01", "year"), (r"^\d{4}-\d{2}$", "-01", "month"), (r"^\d{4}-\d{2}-\d{2}$", "", "day"))
    day = F.coalesce(*[F.when(text.rlike(regex), F.try_to_date(F.concat(text, F.lit(end)), "yyyy-MM-dd")) for regex, end, _ in shapes])
    precision = F.coalesce(*[F.when(text.rlike(regex), F.lit(name)) for regex, _, name in shapes])
    return F.struct(day.alias("day"), F.when(day.isNotNull(), precision).alias("precision"))


def period_end(day: Column, precision: Column) -> Column:
    """The last day of the period that a date of this precision names."""
    year_end = F.make_date(F.year(day), F.lit(12), F.lit(31))
    return F.when(precision == "month", F.last_day(day)).when(precision == "year", year_end).otherwise(day)


def true_index(start: Column, day: Column, spacing: int) -> Column:
    """The largest k with start + k * spacing months on or before day; -1 before start."""
    k = F.floor(months_between(day, start) / spacing).cast("int")
    return F.when(day < start, -1).when(F.add_months(start, k * spacing) > day, k - 1).otherwise(k)


def weekly_dates(start: Column, end: Column, weekday: int = 4) -> Column:
    """Every such weekday (Monday is 0) from start through end, as an array; empty if there is none."""
    first = F.date_add(start, F.pmod(F.lit(weekday) - F.weekday(start), F.lit(7)).cast("int"))
    return F.when(first <= end, F.sequence(first, end, F.expr("INTERVAL 7 DAYS"))).otherwise(F.array().cast("array<date>"))
