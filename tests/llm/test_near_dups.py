import itertools
import random

import corpus_pipeline
from palimpsest.llm import components as components_module
from palimpsest.llm.components import components
from palimpsest.llm.near_dups import COORDINATES, alike, drop_near_duplicates, matches, near_duplicates, postings

from .conftest import prose


def shingled(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingled(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        return x if root[x] == x else find(root[x])

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {(i, len(s), find(i)) for i, s in sets}


def variants(n, words, edits, seed):
    import random

    r = random.Random(seed)
    base = prose(words, seed).split()
    for k in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(words)] = f"new{k}"
        yield " ".join(w)


def test_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    found = near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == brute(rows)
    assert len(found) == docs.count()
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


def test_families_of_near_copies(spark):
    rows = list(enumerate([*variants(60, 150, 5, 1), *variants(40, 300, 9, 2), *variants(5, 4, 1, 3), *[prose(50, s) for s in range(100, 130)]]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert found == brute(rows)


def test_one_of_each_group_stays(docs, none):
    kept = drop_near_duplicates(docs).collect()
    assert drop_near_duplicates(docs).columns == docs.columns
    ids = [r.doc_id for r in kept]
    assert len(ids) == len(set(ids)) and 4 in ids and not {5, 6, 7} & set(ids) and None in ids and {0, 1, 2, 3, 8} <= set(ids)
    assert drop_near_duplicates(none).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r.id, r.root) for r in components(edges).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert components(edges.limit(0)).count() == 0


def test_the_stage_links_at_80_percent_and_op2_at_85(spark):
    base = prose(212, 1).split()
    edited = list(base)
    for i in (20, 60, 100, 140):
        edited[i] = "changed"
    a, b = shingled(" ".join(base)), shingled(" ".join(edited))
    assert 82 <= 100 * len(a & b) / len(a | b) < 84
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited)), (3, prose(200, 9))], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}
    assert {r.doc_id for r in drop_near_duplicates(docs).collect()} == {1, 2, 3}


def test_matches_of_each_bound():
    assert (matches(85), matches(80)) == (14, 11)


def test_hubs_have_the_components_of_all_edges(spark, monkeypatch):
    monkeypatch.setattr(components_module, "HUB", 2)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 30)] + [(100 + i, 101 + i) for i in range(12)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {row.id: row.root for row in components_module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_tables_that_grow_are_not_broadcast_by_their_estimated_size(spark):
    """Postings explode each class COORDINATES-fold, which Spark's sizes leave out; a broadcast of them fills the driver."""
    classes = spark.range(1_000).selectExpr("id as rep", "50L as n", "cast(cast(id as string) as binary) as set_key", f"transform(sequence(1, {COORDINATES}), x -> int(id div 2)) as sig")
    posted = postings(classes, 80)
    for frame in (posted, alike(posted, classes, 80)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.a, r.b) for r in alike(posted, classes, 80).collect()} == {(i, i + 1) for i in range(0, 1_000, 2)}
