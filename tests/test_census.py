"""Two views of a population, nested paths, and the signed cache of texts."""

from datetime import date

import pytest
from palimpsest.functions.nested import as_texts, at_path
from palimpsest.operators.census import ROW, census, differences, hidden_versions, judged, next_pull
from palimpsest.sources.cache import StaleCache, TextCache
from pyspark.sql import functions as F

D = date.fromisoformat


def test_first_cause_that_holds_explains(spark):
    schema = "id long, status string, n int, day date"
    old = spark.createDataFrame([(1, "a", 1, D("2020-01-01")), (2, "a", None, D("2020-01-01")), (3, None, 3, D("2020-01-01")), (4, "x", 0, D("2020-01-01"))], schema)
    new = spark.createDataFrame([(1, "b", 2, D("2020-02-01")), (2, "a", 5, D("2020-01-01")), (3, None, 4, D("2020-01-01")), (5, "new", 0, D("2020-03-01"))], schema)
    later = ("later", F.col("new.day") > F.col("old.day"))
    found = differences(old, new, "id", {"status": [later], "n": [later, ("filled", F.col("old.n").isNull())]}, missing=[("zero", F.col("old.n") == 0)])
    assert {(r.id, r.column, r.cause) for r in found.collect()} == {(1, "status", "later"), (1, "n", "later"), (2, "n", "filled"), (3, "n", "unexplained"), (4, ROW, "zero"), (5, ROW, "unexplained")}
    rows = {(r.column, r.cause): r for r in judged(census(found), 4, {("n", "filled"): 0.1}).collect()}
    assert rows["n", "filled"].n == 1 and not rows["n", "filled"].accepted and rows["status", "later"].accepted and not rows["n", "unexplained"].accepted


def test_versions_that_a_feed_never_showed(spark):
    days = ["2020-01-01", "2020-01-03", "2020-01-08", "2020-01-08", "2020-01-09"]
    log = spark.createDataFrame([(1, n, D(d)) for n, d in enumerate(days)] + [(2, 0, D("2020-01-02"))], "id long, version int, day date")
    pull = next_pull(F.col("day"), D("2020-01-01"), 7)
    assert [r.p for r in log.orderBy("id", "version").select(pull.alias("p")).collect()] == [D(d) for d in ("2020-01-01", "2020-01-08", "2020-01-08", "2020-01-08", "2020-01-15", "2020-01-08")]
    assert {(r.id, r.version): r.cause for r in hidden_versions(log, "id", "version", "day", pull).collect()} == {(1, 1): "between pulls", (1, 2): "same day"}


def plain(record, path):
    """The definition, on dictionaries and lists."""
    if isinstance(record, list):
        found = [plain(x, path) for x in record]
        return [y for x in found if x is not None for y in (x if isinstance(x, list) else [x])]
    head, _, rest = path.partition(".")
    if not isinstance(record, dict) or record.get(head) is None:
        return None
    return plain(record[head], rest) if rest else record[head]


def test_paths_over_nested_lists(spark):
    schema = "a struct<id: int, items: array<struct<name: string, tags: array<struct<v: int>>, deep: array<array<struct<w: int>>>>>, words: array<string>>"
    records = [
        {"a": {"id": 1, "items": [{"name": "x", "tags": [{"v": 1}, {"v": None}, None], "deep": [[{"w": 1}], [], [{"w": 2}, {"w": 3}]]}, {"name": None, "tags": None, "deep": None}, None, {"name": "y", "tags": [], "deep": []}], "words": ["p", None, " "]}},
        {"a": {"id": 2, "items": None, "words": None}}, {"a": None},
    ]
    rows = spark.createDataFrame(records, schema)
    for path in ("a.id", "a.items.name", "a.items.tags.v", "a.items.deep.w", "a.words", "a.none", "a.items.none.v", "b"):
        got = [r.x for r in rows.select(at_path(rows, path).alias("x")).collect()]
        want = [plain(r, path) for r in records]
        assert got == (want if "none" not in path else [None] * 3), path
    assert [r.x for r in rows.select(as_texts(at_path(rows, "a.words")).alias("x")).collect()] == [["p"], [], []]


def test_only_new_texts_are_computed(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def compute(texts):
        def run(frames):
            for f in frames:
                seen.add(len(f))
                yield f.assign(length=f["text"].str.len())[["digest", "length"]]

        return texts.mapInPandas(run, "digest string, length long")

    texts = spark.createDataFrame([(1, "one"), (2, "three"), (3, "one"), (4, None)], "id long, text string")
    cache = TextCache(spark, f"{tmp_path}/cache", {"words": 3})
    assert {r.id: r.length for r in cache.joined(texts, "text", compute).collect()} == {1: 3, 2: 5, 3: 3, 4: None} and seen.value == 2
    assert cache.add(texts, "text", compute) == 0 and seen.value == 2
    more = texts.unionByName(spark.createDataFrame([(5, "fifteen")], texts.schema))
    assert cache.add(more, "text", compute) == 1 and seen.value == 3 and cache.held().count() == 3
    cache.verify()
    with pytest.raises(StaleCache):
        TextCache(spark, f"{tmp_path}/cache", {"words": 4}).joined(texts, "text", compute)
    assert TextCache(spark, f"{tmp_path}/other", {"words": 4}).add(more, "text", compute) == 3
    spark.createDataFrame([("x", 1)], "digest string, length long").write.mode("append").parquet(f"{tmp_path}/cache/rows/batch-000000")
    with pytest.raises(StaleCache):
        cache.verify()
