"""Raw versions in canonical form, and the contract that canonical rows keep."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import partial_date
from ..functions.text import age_in_years, canonical_enum, is_individual, normalize_text, row_digest, sponsor_key, text_hash, titled
from .versions import quarantine


class Layout(NamedTuple):
    """Which raw columns, all of them text but the kept ones, become what. A date with precision also has a raw column
    <date>_type; ages are raw column to years; aliases are of enums, by column."""

    kept: Sequence[str] = ("trial_id", "version", "source")
    dates: Sequence[str] = ()
    precise: Sequence[str] = ()
    enums: Sequence[str] = ()
    ages: Mapping[str, str] = {}
    texts: Sequence[str] = ()
    name: str = "lead_sponsor_name"
    kind: str = "lead_sponsor_class"
    interventions: str | None = None
    aliases: Mapping[str, Mapping[str, str]] = {}


def intervention_kinds(pairs: Column) -> Column:
    """The sorted canonical types of the distinct (name, type) pairs of a list; pairs without a name or a type don't count."""
    typed = F.transform(F.coalesce(pairs, F.array().cast("array<struct<name:string,type:string>>")), lambda p: F.struct(p["name"].alias("name"), canonical_enum(p["type"]).alias("type")))
    given = F.filter(typed, lambda p: p["type"].isNotNull() & (F.coalesce(p["name"], F.lit("")) != ""))
    return F.array_sort(F.transform(F.array_distinct(given), lambda p: p["type"]))


def canonical(raw: DataFrame, layout: Layout) -> DataFrame:
    """One canonical row a raw version: dates, dates with precision and type, enums, years, the sponsor's name and key,
    hashes of normalized texts, types of interventions, and a hash of all of it. A person's name and key are left out, as is the type of
    a date that can't be read. Texts are normalized in one pass of Arrow batches; all else is expressions."""
    enum = lambda c: canonical_enum(F.col(c), layout.aliases.get(c))
    person = is_individual(F.col(layout.name), enum(layout.kind))
    shown = F.when(~person, F.nullif(F.trim(layout.name), F.lit("")))
    columns = {c: partial_date(F.col(c))["day"] for c in layout.dates}
    for c in layout.precise:
        read = partial_date(F.col(c))
        columns |= {c: read["day"], f"{c}_precision": read["precision"], f"{c}_type": F.when(read["day"].isNotNull(), enum(f"{c}_type"))}
    columns |= {c: enum(c) for c in (*layout.enums, layout.kind)}
    columns |= {years: age_in_years(F.col(c)) for c, years in layout.ages.items()}
    columns |= {layout.name: shown, "sponsor_key": sponsor_key(shown), "sponsor_is_individual": person}
    columns |= {f"{c}_hash": text_hash(normalize_text(F.col(c))) for c in layout.texts}
    if layout.interventions:
        columns["intervention_types"] = intervention_kinds(F.col(layout.interventions))
    rows = raw.select(*layout.kept, *[value.alias(name) for name, value in columns.items()])
    return rows.withColumn("content_hash", row_digest(rows, list(columns)))


def contract(layout: Layout, allowed: Mapping[str, Sequence[str]], unknown: Sequence[str], key: str = "trial_id", version: str = "version") -> dict[str, Column]:
    """Name to condition of a canonical row: values of enums that are allowed, years that are not negative, and six rules
    of whole rows. Of rows that share key and version all fail."""
    history, individual = F.col("source") == "history", F.col("sponsor_is_individual")
    checks = {f"{c}: allowed": F.col(c).isin(*values) for c, values in allowed.items()}
    checks |= {f"{years}: not negative": F.col(years) >= 0 for years in layout.ages.values()}
    matching = [F.col(c).isNull() == F.col(f"{c}_precision").isNull() for c in layout.precise] + [F.col(c).isNotNull() | F.col(f"{c}_type").isNull() for c in layout.precise]
    together = F.lit(True)
    for m in matching:
        together = together & m
    copies = F.count("*").over(Window.partitionBy(key, version))
    return checks | {
        "row: history has a version": ~(history & F.col(version).isNull()),
        "row: version is unique": ~(history & (copies > 1)),
        "row: no name of a person": ~(individual & (F.col(layout.name).isNotNull() | F.col("sponsor_key").isNotNull())),
        "row: no key of a title": ~F.coalesce(titled(F.col("sponsor_key")), F.lit(False)),
        "row: precision and type match the date": together,
        "row: last known status only behind an unknown one": F.col("last_known_status").isNull() | F.coalesce(F.col("overall_status").isin(*unknown), F.lit(False)),
    }


def split_valid(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep the contract, and the others with their reasons, sorted, '; ' between."""
    return quarantine(rows, checks)
