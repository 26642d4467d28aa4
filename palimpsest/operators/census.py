"""Two views of one population, and why they differ."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Causes in order: the first that holds explains a difference. Conditions read old.<column> and new.<column>.
Causes = Sequence[tuple[str, Column]]
UNEXPLAINED, ROW = "unexplained", "(row)"


def _first(causes: Causes) -> Column:
    return F.coalesce(*[F.when(condition, F.lit(name)) for name, condition in causes], F.lit(UNEXPLAINED))


def differences(old: DataFrame, new: DataFrame, key: str, columns: Mapping[str, Causes], missing: Causes = (), added: Causes = ()) -> DataFrame:
    """(key, column, cause): one row for each column of a record in which the views differ, and for each record that only
    one of them has (column "(row)"; causes `missing` if the new view lacks it, `added` if the old one does). One join."""
    a, b = old.select(key, F.struct(*[c for c in old.columns if c != key]).alias("old")), new.select(key, F.struct(*[c for c in new.columns if c != key]).alias("new"))
    met = a.join(b, key, "full")
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    row = lambda name, cause: F.struct(F.lit(name).alias("column"), cause.alias("cause"))
    found = [F.when(F.col("new").isNull(), row(ROW, _first(missing))), F.when(F.col("old").isNull(), row(ROW, _first(added)))]
    found += [F.when(both & ~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), row(c, _first(causes))) for c, causes in columns.items()]
    return met.select(key, F.explode(F.array_compact(F.array(*found))).alias("d")).select(key, "d.column", "d.cause")


def census(found: DataFrame) -> DataFrame:
    """(column, cause, n): tallies of differences."""
    return found.groupBy("column", "cause").agg(F.count("*").alias("n"))


def judged(tallies: DataFrame, population: int, bounds: Mapping[tuple[str, str], float]) -> DataFrame:
    """tallies with their share of the population, the largest share that is accepted for the column and cause, and
    whether it is met. Without a bound any number of a named cause is accepted, and none that is unexplained."""
    given = [F.when((F.col("column") == c) & (F.col("cause") == k), F.lit(float(most))) for (c, k), most in bounds.items()]
    most = F.coalesce(*given, F.when(F.col("cause") == UNEXPLAINED, F.lit(0.0)), F.lit(1.0))
    share = F.col("n") / F.lit(max(population, 1))
    return tallies.select("column", "cause", "n", share.alias("share"), most.alias("most"), (share <= most).alias("accepted"))


def hidden_versions(versions: DataFrame, key: str, version: str, posted: str, pull: Column) -> DataFrame:
    """(key, version, posted, cause) of the versions that a feed which shows the latest version only never showed.

    pull: the day of the first pull on or after a version's post date. A version is hidden if a later one was posted by
    then: on the same day, or between the pulls.
    """
    later = F.lead(posted).over(Window.partitionBy(key).orderBy(posted, version))
    cause = F.when(F.col("__next") == F.col(posted), "same day").otherwise("between pulls")
    held = versions.select(key, version, posted, pull.alias("__pull"), later.alias("__next"))
    return held.filter(F.col("__next") <= F.col("__pull")).select(key, version, posted, cause.alias("cause"))


def next_pull(posted: Column, first: date, every: int) -> Column:
    """The day of the first pull on or after a post date, of pulls every so many days from a first one on."""
    gap = F.datediff(posted, F.lit(first))
    return F.when(gap <= 0, F.lit(first)).otherwise(F.date_add(F.lit(first), (F.ceil(gap / every) * every).cast("int")))
