"""Readers: multi-file Parquet by name with casts and provenance, NDJSON, CSV, directories, paged REST."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.compare import schema_drift
from ..operators.versions import latest_per


def file_schemas(spark: SparkSession, files: Sequence[str]) -> dict[str, dict[str, str]]:
    return {f: {c.name: c.dataType.simpleString() for c in spark.read.parquet(f).schema.fields} for f in files}


def read_versions(spark: SparkSession, files: Sequence[str], types: Mapping[str, str]) -> DataFrame:
    """Files with one declared layout by column name: files of one physical schema are scanned together, absent
    columns are null, drifted ones cast; source_file and source_row tell where a row came from."""
    layouts: dict[str, list[str]] = {}
    for f, columns in file_schemas(spark, files).items():
        layouts.setdefault(json.dumps(columns, sort_keys=True), []).append(f)
    out: DataFrame | None = None
    for layout, members in sorted(layouts.items()):
        held = json.loads(layout)
        columns = [(F.col(c) if c in held else F.lit(None)).cast(t).alias(c) for c, t in types.items()]
        part = spark.read.parquet(*members).select(*columns, F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.row_index").alias("source_row"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def drifted_columns(spark: SparkSession, files: Sequence[str]) -> dict[str, dict[str, list[str]]]:
    return schema_drift(file_schemas(spark, files))


def check_layout(new: StructType, pinned: StructType, allowed_new: Sequence[str] = (), retyped: Sequence[str] = ()) -> None:
    """Refuses a release with columns that are missing, new or retyped, but for those allowed."""
    a, b = ({f.name: f.dataType for f in s.fields} for s in (new, pinned))
    faults = [f"missing {c}" for c in b if c not in a] + [f"new {c}" for c in a if c not in b and c not in allowed_new]
    faults += [f"retyped {c}" for c in a if c in b and a[c] != b[c] and c not in retyped]
    if faults:
        raise ValueError("; ".join(sorted(faults)))


def read_latest_json(spark: SparkSession, path: str, schema: str, key: str, version: str) -> DataFrame:
    """Newline-delimited records with a declared schema, so undeclared fields are never read; the latest of each key."""
    return latest_per(spark.read.schema(schema).json(path), [key], version)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def attach(spark: SparkSession, folder: str, tables: Sequence[str], prefix: str = "") -> None:
    """Registers table folders of a build as read-only views."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}").createOrReplaceTempView(prefix + t)


def without_keys(record, names: frozenset[str]):
    """A nested record without the named keys, at any depth."""
    if isinstance(record, dict):
        return {k: without_keys(v, names) for k, v in record.items() if k not in names}
    return [without_keys(x, names) for x in record] if isinstance(record, list) else record


def fetch_json(url: str, params: Mapping[str, str], attempts: int = 4, wait: float = 1.0) -> dict:
    """A reply, asked for again after `wait` seconds, doubled each time, or as long as the server says, while it is busy
    or out of reach; an error that asking again can't mend is raised at once."""
    for n in range(attempts):
        try:
            with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=60) as reply:
                return json.load(reply)
        except OSError as error:
            code, pause = getattr(error, "code", None), wait * 2**n
            if n == attempts - 1 or (code is not None and code < 500 and code not in (408, 429)):
                raise
            told = (getattr(error, "headers", None) or {}).get("Retry-After", "")
            time.sleep(max(pause, float(told)) if told.isdigit() else pause)
    raise AssertionError


def pages(fetch: Callable[[Mapping[str, str]], dict], params: Mapping[str, str], items: str = "studies", cursor: str = "nextPageToken", total: str = "totalCount", least: int = 1) -> Iterator[list[dict]]:
    """Pages of a cursor interface; fails on fewer than `least` records and on another number than the first page announces."""
    expected, seen, token = None, 0, None
    while True:
        reply = fetch({**params, **({"pageToken": token} if token else {})})
        expected = reply.get(total, expected)
        seen += len(reply.get(items, []))
        yield reply.get(items, [])
        token = reply.get(cursor)
        if not token:
            break
    if seen < least or (expected is not None and seen != expected):
        raise ValueError(f"{seen} records, {expected} announced")
