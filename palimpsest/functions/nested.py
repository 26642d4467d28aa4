"""Dotted paths over nested structs and lists, compiled against a schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def _walk(value: Column, kind: DataType, parts: list[str]) -> tuple[Column, DataType] | None:
    if isinstance(kind, ArrayType) and parts:
        inner = kind.elementType
        probe = _walk(F.lit(None), inner, parts)
        if probe is None:
            return None
        found = F.filter(F.transform(value, lambda v: _walk(v, inner, parts)[0]), lambda v: v.isNotNull())
        if isinstance(probe[1], ArrayType):
            return F.filter(F.flatten(found), lambda v: v.isNotNull()), probe[1]
        return found, ArrayType(probe[1])
    if not parts:
        return value, kind
    if not isinstance(kind, StructType) or parts[0] not in kind.names:
        return None
    return _walk(value.getField(parts[0]), kind[parts[0]].dataType, parts[1:])


def at_path(rows: DataFrame, path: str) -> Column:
    """What lies at a path such as a.items.name. Lists met on the way are mapped and flattened, and nulls in them drop out; a
    path that the schema lacks is null, as is one that a record does not have."""
    first, *rest = path.split(".")
    if first not in rows.columns:
        return F.lit(None)
    found = _walk(F.col(f"`{first}`"), rows.schema[first].dataType, rest)
    return F.lit(None) if found is None else found[0]


def as_texts(value: Column) -> Column:
    """A list of the values that are given, as text; empty for null. A blank text is not given."""
    texts = F.transform(F.coalesce(value.cast("array<string>"), F.array().cast("array<string>")), lambda v: v)
    return F.filter(texts, lambda v: v.isNotNull() & (F.trim(v) != ""))


def flattened(rows: DataFrame, plain: Mapping[str, str], lists: Mapping[str, str], sets: Mapping[str, str], counts: Mapping[str, str], distinct_counts: Mapping[str, str]) -> DataFrame:
    """One flat row a record, each column by its path: values as they are, lists in their order, sorted distinct lists, and
    numbers of values and of distinct values."""
    texts = lambda path: as_texts(at_path(rows, path))
    return rows.select(
        *[at_path(rows, path).alias(name) for name, path in plain.items()],
        *[texts(path).alias(name) for name, path in lists.items()],
        *[F.array_sort(F.array_distinct(texts(path))).alias(name) for name, path in sets.items()],
        *[F.size(texts(path)).alias(name) for name, path in counts.items()],
        *[F.size(F.array_distinct(texts(path))).alias(name) for name, path in distinct_counts.items()],
    )
