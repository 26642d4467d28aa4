import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm.decontaminate import decontaminate, words
from palimpsest.llm.fm_index import FMIndex, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


@given(st.text())
def test_words(text):
    assert [w.decode() for w in words(text)] == split(text)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=60))
def test_suffix_array(s):
    assert suffix_array(np.array(s)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=25), min_size=1, max_size=6), st.integers(1, 4))
def test_index_finds_and_locates(runs, n):
    starts = np.cumsum([0, *map(len, runs)])[:-1]
    index = FMIndex(np.concatenate(runs), starts, 3, every=4)
    patterns = np.array(np.meshgrid(*[[1, 2, 3]] * n)).T.reshape(-1, n)
    low, high = index.find(patterns)
    for p, a, b in zip(patterns, low, high):
        want = sorted(int(index.run_starts[k]) + i for k, r in enumerate(runs) for i in range(len(r) - n + 1) if r[i : i + n] == p.tolist())
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([item] if item is not None else [])
    out = []
    for text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block", [8_000_000, 40])
def test_against_brute_force(spark, docs, texts, block):
    cut = lambda i, a, b: " ".join(texts[i].split()[a:b])
    items = [(1, cut(8, 75, 100)), (2, cut(8, 90, 120).upper()), (2, cut(8, 90, 120)), (3, "One"), (4, None), (5, ""), (None, cut(4, 10, 25)), (6, "é ß"), (7, cut(4, 0, 10)), (8, "x y x y x y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate(docs, bench, block_chars=block).collect()
    want = brute([r.text for r in rows], [(str(i) if i is not None else None, t) for i, t in items])
    got = [(r.n_words, sum(s.end - s.begin for s in r.spans), r["items"]) for r in rows]
    assert got == want and len(rows) == docs.count()


def test_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, bench).filter("size(spans) > 0").count() == 0
    assert decontaminate(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
