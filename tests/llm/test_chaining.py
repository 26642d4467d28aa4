import random
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm import chaining
from palimpsest.llm.chaining import GAP_COST, K, Fenwick, align, chains, minimizers, repeated_passages, word_hashes

from pyspark.sql import functions as F

from .conftest import prose


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=7, unique=True))
def test_best_chain_against_all_chains(points):
    points = sorted(points)

    def best(i):
        after = [K + best(j) - GAP_COST * (points[j][0] - points[i][0] + points[j][1] - points[i][1]) - 0.0 for j in range(i + 1, len(points)) if points[j][0] > points[i][0] and points[j][1] > points[i][1]]
        return max([0.0, *after])

    value = lambda c: K * len(c) - sum(GAP_COST * (q[0] - p[0] + q[1] - p[1]) for p, q in zip(c, c[1:]))
    found = chains(np.array([p for p, _ in points]), np.array([q for _, q in points]))
    assert abs(value(found[0]) - max(K + best(i) for i in range(len(points)))) < 1e-9
    assert sorted(p for c in found for p in c) == points
    assert all(p[0] < q[0] and p[1] < q[1] for c in found for p, q in zip(c, c[1:]))


def test_fenwick():
    r, tree, held = random.Random(1), Fenwick(20), {}
    for n in range(60):
        i, v = r.randrange(20), r.random()
        tree.put(i, (v, n))
        held[i] = max(held.get(i, (-1, 0)), (v, n))
        k = r.randrange(1, 21)
        assert tree.top(k) == max([x for j, x in held.items() if j < k], default=(-1e18, -1))


def test_equal_stretches_share_seeds():
    text = prose(40, 3)
    for a, b in ((1, 2), (30, 70), (7, 0)):
        x, y = (minimizers(word_hashes(f"{prose(n, 50 + n)} {text} {prose(n + 3, 90 + n)}"))[0] for n in (a, b))
        assert len(set(x.tolist()) & set(y.tolist())) >= 2


def test_alignment_passes_small_edits():
    x = np.arange(100, 200)
    y = np.concatenate([np.arange(5), x[10:40], [7], x[42:70], x[71:90], np.arange(5)])
    (u, v, p, q, n), *rest = align(x, y, [(20, 15), (60, 54)])
    assert (u, v, p, q) == (10, 90, 5, 83) and n == 30 + 28 + 19 and not rest


def exact(rows, least=50):
    where = {}
    for i, t in rows:
        w = (t or "").lower().split()
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(i)
    return {i for s in where.values() if len(s) > 1 for i in s}


def test_against_exact_windows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    found = repeated_passages(docs).collect()
    assert exact(rows) == {r.doc_id for r in found}
    words = {i: (t or "").lower().split() for i, t in rows}
    for r in found:
        assert 50 <= r.n_matched <= min(r.end - r.begin, r.other_end - r.other_begin) and r.doc_id != r.other_id
        assert r.end <= len(words[r.doc_id]) and r.other_end <= len(words[r.other_id])
    assert any((r.doc_id, r.begin, r.end) == (8, 80, 140) for r in found) or any(r.doc_id == 8 and r.begin == 80 for r in found)


def test_many_share_one_passage_and_fuzzy_ones(spark):
    passage = prose(70, 1)
    bent = passage.split()
    bent[30], bent[50] = "other", "words"
    rows = [(i, f"{prose(30 + i, 200 + i)} {passage} {prose(20, 300 + i)}") for i in range(40)] + [(50, prose(40, 7) + " " + " ".join(bent)), (51, prose(90, 8)), (52, "was " * 60 + prose(9, 9)), (53, prose(9, 10) + " was" * 55)]
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {*range(40), 50, 52, 53}
    assert len(found) < 4 * len(rows)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_fragments_in_lower_ids_hide_no_passage(spark):
    """Two texts that share 64 words, of which lower ids hold pieces of 21."""
    passage = prose(64, 31).split()
    rows = [(i, f"{prose(40, 400 + i)} {' '.join(passage[16 * i : 16 * i + 21])} {prose(40, 500 + i)}") for i in range(4)]
    rows += [(i, f"{prose(30, 600 + i)} {' '.join(passage)} {prose(30, 700 + i)}") for i in (100, 101)]
    assert {r.doc_id for r in repeated_passages(frame(spark, rows)).collect()} == {100, 101}


def test_common_pieces_hide_no_passage(spark):
    """Pieces of 30 words of one passage in twelve lower ids each, so that every seed has many places; two texts of 90 words."""
    passage = prose(90, 32).split()
    rows = [(i, f"{prose(40, 800 + i)} {' '.join(passage[20 * (i % 4) : 20 * (i % 4) + 30])} {prose(40, 900 + i)}") for i in range(48)]
    rows += [(i, f"{prose(30, 600 + i)} {' '.join(passage)} {prose(30, 700 + i)}") for i in (100, 101)]
    found = repeated_passages(frame(spark, rows).withColumns({"seed": F.lit(1), "window": F.lit("w"), "a": F.lit(2), "words": F.lit(3)})).collect()
    assert {r.doc_id for r in found} == exact(rows) == {100, 101} and max(r.n_matched for r in found) >= 90


@pytest.mark.parametrize(("gap", "least"), [(8, 0.9), (10, 0.95), (15, 0.98)])
def test_scattered_edits(spark, gap, least):
    """Copies of 90 words with one word of each `gap` replaced, all of which keep 50 equal words, against a full alignment."""
    rows, pairs = [], 60
    for n in range(pairs):
        words = prose(90, 3_000 + n).split()
        bent = [f"edit{n}x{i}" if i % gap == n % gap else w for i, w in enumerate(words)]
        rows += [(2 * n, f"{prose(60, 5_000 + n)} {' '.join(words)} {prose(60, 6_000 + n)}"), (2 * n + 1, f"{prose(60, 7_000 + n)} {' '.join(bent)} {prose(60, 8_000 + n)}")]
        assert sum(b.size for b in SequenceMatcher(None, words, bent, autojunk=False).get_matching_blocks()) >= 50
    found = {(r.doc_id, r.other_id) for r in repeated_passages(frame(spark, rows)).collect()}
    assert found <= {(i, i ^ 1) for i in range(2 * pairs)}
    assert len(found) >= least * 2 * pairs


def edited(words, every, shift, name):
    return " ".join(f"{name}x{i}" if i % every == shift % every else w for i, w in enumerate(words))


@pytest.mark.parametrize("every", [12, 20])
def test_common_pieces_hide_no_edited_passage(spark, every):
    """An edited pair of 120 words, whose pieces of 25 words are held by sixty lower ids: every seed is common, no 50 words are equal."""
    passage = prose(120, 41).split()
    rows = [(i, f"{prose(40, 10_000 + i)} {' '.join(passage[8 * (i % 12) : 8 * (i % 12) + 25])} {prose(40, 11_000 + i)}") for i in range(60)]
    rows += [(100, f"{prose(30, 12_000)} {' '.join(passage)} {prose(30, 12_001)}"), (101, f"{prose(30, 12_002)} {edited(passage, every, 5, 'edit')} {prose(30, 12_003)}")]
    assert {(r.doc_id, r.other_id) for r in repeated_passages(frame(spark, rows)).collect()} == {(100, 101), (101, 100)}


def alone(x, y):
    """Whether two texts by themselves, all of whose equal seeds are matched, share a passage."""
    x, y = word_hashes(x), word_hashes(y)
    (s, p), (t, q) = minimizers(x), minimizers(y)
    i, j = np.nonzero(s[:, None] == t[None, :])
    points = np.array(sorted(set(zip(p[i].tolist(), q[j].tolist()))), np.int64).reshape(-1, 2)
    found = [c for c in chains(points[:, 0], points[:, 1]) if len(c) > 1] if len(points) else []
    return any(n >= 50 for c in found for *_, n in align(x.tolist(), y.tolist(), c))


@pytest.mark.parametrize(("length", "paired", "cell"), [(90, 16, 1_024), (140, 2, 3)])
def test_edited_copies_are_linked_or_meet_at_one(spark, monkeypatch, length, paired, cell):
    """Of twelve copies with a tenth of the words edited, all pairs are found that are found with no third text about; where
    a group is above the number that is paired at once, directly or through one with whom both share a passage."""
    monkeypatch.setattr("palimpsest.llm.chaining.PAIRED", paired, raising=False)
    monkeypatch.setattr("palimpsest.llm.chaining.CELL", cell, raising=False)
    passage, r = prose(length, 42).split(), random.Random(5)
    texts = [" ".join([prose(30, 13_000 + i), *[f"e{i}x{k}" if r.random() < 0.1 else w for k, w in enumerate(passage)], prose(30, 14_000 + i)]) for i in range(12)]
    found = {(r.doc_id, r.other_id) for r in repeated_passages(frame(spark, list(enumerate(texts)))).collect()}
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12) if alone(texts[a], texts[b])]
    met = [(a, b) for a, b in pairs if (a, b) in found or paired < 12 and any({(a, c), (b, c)} <= found for c in range(12))]
    assert len(pairs) > 25 and met == pairs


def test_holders_apart_from_the_centre_are_compared(spark, monkeypatch):
    """Texts alike only at both ends of a stretch of 60 words, and an edited pair among them whose middle is made of common pieces."""
    monkeypatch.setattr("palimpsest.llm.chaining.PAIRED", 3, raising=False)
    monkeypatch.setattr("palimpsest.llm.chaining.CELL", 4, raising=False)
    head, tail, pool = prose(15, 51), prose(15, 52), [prose(14, 60 + i) for i in range(12)]
    order = [4, 7, 1]
    rows = [(i, f"{prose(40, 15_000 + i)} {head} {prose(42, 16_000 + i)} {tail} {prose(40, 17_000 + i)}") for i in range(12)]
    rows += [(20 + i, f"{prose(40, 18_000 + i)} {pool[i % 12]} {prose(40, 19_000 + i)}") for i in range(72)]
    middle = lambda n: " ".join(f"{pool[p]} n{n}" for p in order)
    rows += [(i, f"{prose(30, 20_000 + i)} {head} n{i} {middle(i)} {tail} {prose(30, 21_000 + i)}") for i in (200, 201)]
    assert {(r.doc_id, r.other_id) for r in repeated_passages(frame(spark, rows)).collect()} == {(200, 201), (201, 200)}


def test_many_with_two_everyday_lines_are_not_paired(spark, monkeypatch):
    """Sixty texts alike only in a line of 20 words at either end of 30 others: of 59 apart from the centre no pair is joined."""
    links = []
    plain = chaining.meeting
    monkeypatch.setattr(chaining, "meeting", lambda found: links.append(found.count()) or plain(found))
    head, tail = prose(20, 81), prose(20, 82)
    rows = [(i, f"{prose(40, 22_000 + i)} {head} {prose(30, 23_000 + i)} {tail} {prose(40, 24_000 + i)}") for i in range(60)]
    assert repeated_passages(frame(spark, rows)).count() == 0
    assert links[0] > 0 and links[-1] == 0


def test_pairs_of_a_cell_by_their_words():
    """Against a count of each pair's words that lie in three the other has too, and of the keys that lead to both."""
    r = random.Random(9)
    words = [[r.randrange(4) for _ in range(r.randint(K, 40))] for _ in range(24)]
    left, lone, doc = [i < 9 for i in range(24)], [i < 9 or r.random() < 0.3 for i in range(24)], [r.randrange(14) for _ in range(24)]
    wide = [r.choice([45, 50, 70]) for _ in range(24)]
    keys = [sorted(r.sample(range(8), r.randint(1, 3))) + [0] * (r.random() < 0.1) for _ in range(24)]
    only = [[k for k in set(k) if r.random() < 0.4] for k in keys]
    me = [{"doc_id": d, "at": i, "to": i + w} for i, (d, w) in enumerate(zip(doc, wide))]
    table = pa.table({"left": left, "me": pa.array(me, pa.struct([("doc_id", pa.int64()), ("at", pa.int32()), ("to", pa.int32())])), "alone": lone, "words": pa.array([np.array(w, "<u4").tobytes() for w in words]), "keys": pa.array(keys, pa.list_(pa.int64())), "lone": pa.array(only, pa.list_(pa.int64()))})
    table = table.take(pa.array(r.sample(range(24), 24)))

    def linked(x, y):
        runs = {tuple(words[x][i : i + 3]) for i in range(len(words[x]) - 2)}
        covered = {i + k for i in range(len(words[y]) - 2) if tuple(words[y][i : i + 3]) in runs for k in range(3)}
        shared = {k for k in keys[x] if k in keys[y] and (k in only[x] or k in only[y])}
        chained = len(shared) > 1 or GAP_COST * (wide[x] + wide[y]) <= K or any(len(set(keys[i])) < len(keys[i]) for i in (x, y))
        return len(covered) >= 12 and chained and doc[x] != doc[y] and (not lone[y] or doc[x] < doc[y])

    found = chaining._alike(12)(table).to_pylist()
    expected = {(x, y) for x in range(9) for y in range(9, 24) if linked(x, y)}
    assert {(f["x"]["at"], f["y"]["at"]) for f in found} == expected and len(found) == len(expected) > 5


def test_words_and_seeds_of_many_texts_at_once(texts):
    more = ["was " * 60, "a b " * 30 + "c d e", " \t\x0b\x1cx\u00a0y  ", *[" ".join(f"w{i}" for i in range(n)) for n in range(18)], *["é" * n + "Q" * (n % 3) for n in range(1, 40)], prose(90, 83)]
    h, bounds = chaining.hashed(pa.array([*texts, *more], pa.string()))
    found, text, at = chaining.minimizers_all(h, bounds)
    for i, t in enumerate([*texts, *more]):
        assert h[bounds[i] : bounds[i + 1]].tolist() == word_hashes(t).tolist()
        alone = minimizers(word_hashes(t))
        assert sorted(zip(*(x[text == i].tolist() for x in (found, at)))) == sorted(zip(*(x.tolist() for x in alone)))


def test_clean_texts_are_left_alone(spark):
    line = prose(30, 77)
    rows = [(i, f"{prose(120, 9_000 + i)} {line} {prose(120, 9_500 + i)}") for i in range(300)]
    assert repeated_passages(frame(spark, rows)).count() == 0


def test_empty_table(none):
    assert repeated_passages(none).count() == 0
