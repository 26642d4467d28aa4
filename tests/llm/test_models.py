import random

import numpy as np
import pytest
from palimpsest.llm import language, toxicity
from pyspark.sql import functions as F

from .conftest import prose

LETTERS = {"aa": "abcde", "bb": "defgh", "cc": "ghijé"}


@pytest.fixture(scope="module")
def many(spark):
    rows = []
    for i in range(240):
        r = random.Random(i)
        lang = sorted(LETTERS)[i % 3]
        text = " ".join("".join(r.choices(LETTERS[lang], k=r.randint(1, 6))) for _ in range(r.randint(5, 60)))
        rows.append((i, text, lang if i % 10 else None))
    rows += [(1_000, None, "aa"), (1_001, "", "aa"), (1_002, "123 !", None), (None, "abc abc", "aa"), (5, rows[5][1], rows[5][2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_held_out_rows(many):
    learn = F.col("doc_id") % 4 != 1
    model = language.train(many, learn)
    assert model.languages == ["aa", "bb", "cc"]
    rows = language.identify(many, model).collect()
    truth = {r.doc_id: r.text for r in many.collect()}
    assert len(rows) == many.count() and all(0 <= r.score <= 1 for r in rows)
    right = [r.lang_pred == sorted(LETTERS)[r.doc_id % 3] for r in rows if r.doc_id is not None and r.doc_id < 1_000]
    assert np.mean(right) > 0.95
    assert {r.lang_pred for r in rows if truth.get(r.doc_id) in (None, "", "123 !")} == {"und"}


def test_nothing_to_learn(many):
    model = language.train(many.limit(0), F.lit(True))
    assert {(r.lang_pred) for r in language.identify(many, model).collect()} == {"und"}
    assert language.identify(many.limit(0), model).count() == 0


def test_ftrl_is_sparse_and_temperature_fits():
    r = np.random.default_rng(1)
    rows = [(np.array([i % 2, 5 + r.integers(20), language.FEATURES]), np.ones(3), i % 2) for i in range(200)]
    w, bias = language.ftrl(rows, 2)
    assert np.count_nonzero(np.abs(w).sum(axis=1)) < 40 and w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    p = r.random(4_000)
    y = (r.random(4_000) < p).astype(int)
    sharp = np.stack([np.zeros_like(p), 3 * np.log(p / (1 - p))], axis=1)
    assert abs(language.best_temperature(sharp, y) - 3) < 0.3


def test_grammar_reads_clauses():
    s = toxicity.Scorer({b"moron": 2.0})
    reading = lambda t: dict(zip(toxicity.READINGS, s.features(t)))
    hot = lambda t: {k for k, v in reading(t).items() if v}
    assert hot("what a moron this is") == {"plain"}
    assert hot("You are such a Moron!") == {"aimed"}
    assert hot("that is not a moron") == {"negated"}
    assert hot("he said the moron left") >= {"reported"}
    assert hot("I kill you") == {"aimed"} and hot("I kill time. You know") == set()
    assert hot("not now. moron") == {"plain"}
    assert hot(None) == hot("") == hot("fine words") == set()
    assert s.features("moron. " * 3)[0] > s.features("moron. ok. ok")[0]


def test_compose_equals_running_both():
    a, b = toxicity.within("target", 2, {"plain": "aimed"}), toxicity.within("negation", 2, {"aimed": "negated"})
    alphabet = {"target", "negation", "plain", "other"}
    both, r = toxicity.compose(a, b, alphabet), random.Random(3)
    for _ in range(100):
        x, y, z = a.start, b.start, both.start
        for symbol in r.choices(sorted(alphabet), k=12):
            x, w = a.step(x, symbol)
            y, w = b.step(y, w)
            z, v = both.step(z, symbol)
            assert v == w


@pytest.fixture(scope="module")
def labelled(spark):
    rows, labels = [], []
    for i in range(500):
        words = prose(60, 1_000 + i).split()
        toxic = i % 4 == 0
        if toxic:
            for k in range(4):
                words[(7 + 13 * k + i) % 60] = ["zork", "blat", "idiot"][(i + k) % 3]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (None, "zork zork zork")]
    labels += [(3, 0, 0), (902, 1, None), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_rows(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, F.col("doc_id") % 5 != 0)
    assert {b"zork", b"blat"} <= set(model.weights)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in rows if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 5 == 0]
    assert np.mean(held) > 0.95
    assert all(r.score < 0.5 for r in rows if r.doc_id in (900, 901))


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.limit(0), F.lit(True))
    rows = toxicity.score(docs.withColumn("score", F.lit("x")), model).collect()
    assert all(isinstance(r.score, float) for r in rows)
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_copies_do_not_fake_a_word(spark):
    text = prose(40, 5)
    docs = spark.createDataFrame([(i, text if i < 30 else prose(40, 100 + i)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 30)) for i in range(200)], "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample(docs, labels, F.lit(True))
    assert set(toxicity.learn_words(sample)) == {w.encode() for w in toxicity.SEEDS}
