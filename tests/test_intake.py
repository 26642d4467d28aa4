"""Raw records: conversion, reasons, idempotent sinks."""

import hashlib

from palimpsest.streaming.intake import Field, intake, run_intake
from pyspark.sql import functions as F

CONTRACT = {"id": Field("$.id", "bigint", True), "name": Field("$.who.name", "string"), "day": Field("$.day", "date", True), "share": Field("$.share", "double"), "ok": Field("$.ok", "boolean"), "tags": Field("$.tags", "array<string>")}
GOOD = ['{"id": 1, "who": {"name": "x"}, "day": "2020-01-31", "share": 0.5, "ok": true, "tags": ["a", "b"]}', '{"id": 2, "day": "2020-02-29", "share": 3, "who": {}, "tags": null, "more": [1]}']
BAD = {
    '{"id": "3", "day": "2020-01-01"}': "id: not bigint",
    '{"id": 4, "day": "2020-02-30", "ok": "yes"}': "day: not date; ok: not boolean",
    '{"who": {"name": 5}, "day": null}': "day: missing; id: missing; name: not string",
    '{"id": 5, "day": "2020-01-01"': "not a JSON object",
    "[1, 2]": "not a JSON object",
    '{"id": -1, "day": "2020-01-01"}': "negative",
    '{"id": 6.5, "day": "2020-01-01", "tags": "a"}': "id: not bigint; tags: not array<string>",
}


def checks():
    return {"negative": F.col("id") >= 0}


def test_each_record_for_itself(spark):
    rows = spark.createDataFrame([(r, i) for i, r in enumerate([*GOOD, *BAD, None])], "raw string, id int")
    good, bad = intake(rows.withColumnRenamed("id", "line"), CONTRACT, checks())
    got = {r.line: r for r in good.collect()}
    assert set(got) == {0, 1} and (got[0].name, str(got[0].day), got[0].share, got[0].ok, got[0].tags) == ("x", "2020-01-31", 0.5, True, ["a", "b"])
    assert (got[1].id, got[1].name, got[1].share, got[1].ok, got[1].tags) == (2, None, 3.0, None, None)
    found = {r.raw: r for r in bad.collect()}
    assert {raw: r.reasons for raw, r in found.items()} == BAD | {None: "not a JSON object"}
    assert all(r.digest == hashlib.sha256((raw or "").encode()).hexdigest() for raw, r in found.items())


def test_a_stream_of_files_is_taken_in_once(spark, tmp_path):
    for n, lines in enumerate(([GOOD[0], *list(BAD)[:4], ""], [GOOD[1], GOOD[1], *list(BAD)[4:]])):
        spark.createDataFrame([(line,) for line in lines], "raw string").coalesce(1).write.mode("append").text(f"{tmp_path}/source")
        for _ in range(2):
            run_intake(spark, f"{tmp_path}/source", f"{tmp_path}/good", f"{tmp_path}/bad", f"{tmp_path}/mark{0 if n == 0 else ''}", CONTRACT, checks(), ["id", "digest"], files_per_batch=1)
    good, bad = spark.read.parquet(f"{tmp_path}/good"), spark.read.parquet(f"{tmp_path}/bad")
    assert sorted(r.id for r in good.collect()) == [1, 2] and {r.raw: r.reasons for r in bad.collect()} == BAD and bad.count() == len(BAD)
