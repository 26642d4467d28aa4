import random
import re

import numpy as np
import pytest
import xxhash

from palimpsest.llm import simhash as m

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(ids, prints, distance=3):
    """Least id reachable over all pairs."""
    prints, found = np.array(prints, np.uint64), dict(zip(range(len(ids)), range(len(ids))))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(prints[:i] ^ prints[i]) <= distance):
            found[root(i)] = root(int(j))
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_follow_their_definition(texts):
    more = ["x", "a b", "A  B\tC", "É ß İ x y z", "w " * 70_000, " ".join(str(i) for i in range(20_000))]
    for text in [*texts, *more]:
        assert m.fingerprint(text) == plain(text), (text or "")[:40]


def test_hard_rows(docs, spark):
    rows = m.simhash_duplicates(docs).collect()
    source = docs.select("doc_id", "text").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in rows) == sorted((r.doc_id is None, r.doc_id or 0, f"{plain(r.text):016x}") for r in source)
    with_id = [r for r in rows if r.doc_id is not None]
    assert [r.component_id for r in with_id] == classes([r.doc_id for r in with_id], [int(r.fingerprint, 16) for r in with_id])
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert len({r.component_id for r in with_id if r.fingerprint == "0" * 16}) == 1  # null, empty and blank are linked


def test_no_rows(none):
    out = m.simhash_duplicates(none)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0


@pytest.mark.parametrize("parts", [2, 7])
def test_links_equal_all_pairs(spark, parts):
    """Random prints, near copies up to four bits off, chains, and a family that is larger than many leaves."""
    r = random.Random(parts)
    prints = {r.getrandbits(64) for _ in range(700)} | {0, 2**64 - 1, 2**63}
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    prints |= {flip(x, r.randint(1, 4)) for x in list(prints)[:300]}
    chain = r.getrandbits(64)
    for _ in range(20):
        chain = flip(chain, 3)
        prints.add(chain)
    family = r.getrandbits(64)
    prints |= {flip(family, r.randint(1, 3)) for _ in range(900)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    held = spark.createDataFrame([(b,) for b in signed], "bits long").repartition(parts)
    roots = {row.id: row.root for row in m.near_fingerprints(held).collect()}
    assert [roots.get(b, b) for b in signed] == classes(signed, prints)


def test_gray_order_neighbours_differ_in_one_bit(spark):
    from pyspark.sql import functions as F

    rows = spark.range(256).select(m.gray_rank(F.col("id")).alias("rank"), "id").orderBy("rank").collect()
    assert all((a.id ^ b.id).bit_count() == 1 for a, b in zip(rows, rows[1:]))


def test_pairs_of_nodes_are_pruned(spark):
    """Below a shared top node about half of the pairs of leaves are compared at this size; of a family of near copies few."""
    r = random.Random(5)
    top = r.getrandbits(16) << 48
    prints = np.array([top | r.getrandbits(48) for _ in range(30_000)], np.uint64).view(np.int64).tolist()
    held = m.leaf_table(spark.createDataFrame([(b,) for b in prints], "bits long"), 3)
    n, met = held.join(held.groupBy("space").count().filter("count > 100"), "space").count(), m.near_leaves(held, spark.createDataFrame([], "id long, root long"), 3).count()
    assert n > 400 and 0 < met < 0.5 * n * n / 2
    base = r.getrandbits(64)
    family = {base ^ 1 << a ^ 1 << b for a in range(64) for b in range(64)} | {base ^ 1 << a for a in range(64)} | {base}
    held = m.leaf_table(spark.createDataFrame([(b,) for b in np.array(sorted(family), np.uint64).view(np.int64).tolist()], "bits long"), 3)
    n = held.join(held.groupBy("space").count().filter("count > 1"), "space").count()
    assert m.near_leaves(held, m.components(m.linked_within(held, 3)), 3).count() < 0.2 * n * n / 2


def test_other_distances(spark):
    r = random.Random(9)
    prints = {r.getrandbits(64) for _ in range(200)}
    prints = sorted(prints | {x ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for x in prints})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    for distance in (0, 1, 4, 6):
        roots = {row.id: row.root for row in m.near_fingerprints(spark.createDataFrame([(b,) for b in signed], "bits long"), distance).collect()}
        assert [roots.get(b, b) for b in signed] == classes(signed, prints, distance)
