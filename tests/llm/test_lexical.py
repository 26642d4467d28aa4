import math
import random
import re

import pytest

from palimpsest.llm import lexical as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def plain(docs, items, k):
    """Scores of all documents for all items, from the definition."""
    held = [(d, split(t)) for d, t in docs if d is not None]
    held = [(d, t) for d, t in held if t]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(split(t))
    df = {}
    for _, t in held:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, ts in wanted.items():
        found = []
        for d, t in held:
            low = 10 + 90 * len(t) * n_docs // length
            total = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * low)) for x in ts & set(t))
            if total > 0:
                found.append((-total, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def corpus(seed, n=160):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4_000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(25)]  # ties
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 25)))) for i in range(12)]
    return docs, items


def found(spark, docs, items, k=5):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    return sorted(tuple(row) for row in m.search(d, spark.createDataFrame(items, "item_id long, text string"), k).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_scoring_everything(spark, seed):
    docs, items = corpus(seed)
    assert found(spark, docs, items) == plain(docs, items, 5)


def test_without_broadcasts(spark, monkeypatch):
    docs, items = corpus(3)
    monkeypatch.setattr(m, "TERMS_SENT", 1)
    monkeypatch.setattr(m, "ROWS_SENT", 0)
    assert found(spark, docs, items) == plain(docs, items, 5)


def test_hard_rows(spark, docs):
    rows = [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    items = [(1, "a b c x ONE é nowhere"), (1, "ba"), (2, None), (3, ""), (4, "nowhere at_all"), (None, "a"), (5, "x " * 3_000 + rows[4][1]), (5, "x")]
    frame = spark.createDataFrame([(*i, "en", 1, 2) for i in items], "item_id long, text string, doc_id string, score int, n int")
    got = sorted(tuple(r) for r in m.search(docs, frame, 3).collect())
    assert got == plain(rows, items, 3)
    assert {r[0] for r in got} == {1, 5}


def test_no_rows(spark, none, docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for d, i in ((none, items), (docs, items.limit(0)), (none, items.limit(0))):
        out = m.search(d, i)
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_common_terms_are_pruned(spark):
    """The join leaves terms out, and no threshold is above the kth score."""
    docs, items = corpus(4, 1_500)
    wanted = m.stored(m.item_terms(spark.createDataFrame(items, "item_id long, text string")))
    held = m.stored(m.index(spark.createDataFrame(docs, "doc_id long, text string"), wanted.select("term").distinct()))
    n, length = held.filter("n > 0").selectExpr("count(*)", "sum(n)").first()
    weights = held.selectExpr("explode(map_keys(tf)) AS term").groupBy("term").count().selectExpr("term", f"cast(floor(1000 * ln({2.0 * n + 2}D / (2 * count + 1))) as long) AS w")
    every = m.postings(held, weights, n, length)
    strongest = every.selectExpr("term", "row", "row_number() OVER (PARTITION BY term ORDER BY impact DESC, row) AS place", "impact").filter("place <= 5")
    seeds = m.scored(wanted.join(strongest, "term").select("item_id", "row").distinct(), held, wanted, weights, n, length)
    bounds = {r.item_id: r.threshold for r in m.thresholds(wanted, strongest, seeds, 5).collect()}
    last = {}
    for i, rank, _, s in plain(docs, items, 5):
        if rank == 5:
            last[i] = s
    assert all(0 < bounds[i] <= last[i] for i in last)
    parts = m.split_terms(wanted, strongest, spark.createDataFrame(list(bounds.items()), "item_id long, threshold long"))
    kept, pruned = (every.join(parts.filter(f"pruned = {p}"), "term").count() for p in (False, True))
    assert pruned > kept
