"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's features are its character 1- to 3-grams (lower case, runs of non-letters as one space),
hashed to FEATURES buckets, as term frequency times inverse document frequency, scaled to length 1.
Document frequencies are counted over every learning row. Weights are trained with
follow-the-regularised-leader and an elastic net (l1 keeps the weights sparse, l2 small) on at most
about SAMPLE rows of each language, whole texts; a fifth of them is kept apart to fit the temperature
that calibrates the probabilities. The score is the calibrated probability of the predicted language.

A null text or one without a letter is `und` with score 1; where nothing could be learned, every text
is `und` with score 0. Ties go to the language that sorts first. Repeated rows are predicted one by one. Only doc_id and
text are read, and lang for learning, so further columns may have any names. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, in_batches, mapped, read, stored

FEATURES, SAMPLE, EPOCHS = 1 << 15, 3_000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.02
GAPS = re.compile(r"[\W\d_]+")


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a text."""
    codes = np.frombuffer(f" {GAPS.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    one = codes * np.uint32(2_654_435_761)
    two = (one[:-1] ^ (codes[1:] * np.uint32(2_246_822_519) + np.uint32(0x9E37))) * np.uint32(3_266_489_917)
    three = (two[:-1] ^ (codes[2:] * np.uint32(668_265_263) + np.uint32(0x79B9))) * np.uint32(374_761_393)
    buckets = np.concatenate([one, two, three]) >> np.uint32(32 - FEATURES.bit_length() + 1)
    return np.bincount(buckets, minlength=FEATURES)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts with a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for (texts,) in in_batches(1, 0, batches):
            for t in filter(has_letter, texts):
                total += counts(t) > 0
                n += 1
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*held, -1], pa.int32()), pa.array([*total[held], n], pa.int64())], ["bucket", "n"])

    rows = mapped(docs.select("text"), count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = {r["bucket"]: r["n"] for r in rows}
    n = total.pop(-1, 0)
    out = np.zeros(FEATURES)
    out[list(total)] = list(total.values())
    return out, n


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages, with the idf multiplied in
    idf: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for text in texts:
            if not has_letter(text) or not self.languages:
                langs.append("und")
                scores.append(0.0 if has_letter(text) else 1.0)
                continue
            found = counts(text)
            held = np.flatnonzero(found)
            tf = found[held].astype(float)
            z = (tf @ self.weights[held]) / math.sqrt(((tf * self.idf[held]) ** 2).sum() or 1.0) + self.bias
            p = softmax(z[None] / self.temperature)[0]
            best = int(p.argmax())
            langs.append(self.languages[best])
            scores.append(float(min(1.0, p[best])))
        return langs, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal over sparse rows (buckets, values, class); the last bucket is the bias, without l1."""
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    order = np.random.default_rng(7)

    def solve(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == FEATURES, 0.0, L1)[:, None]
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = solve(at)
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(FEATURES + 1))
    return w[:-1], w[-1]


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm."""
    loss = lambda t: -np.log(np.maximum(softmax(logits / math.exp(t))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, ratio = -1.0, 4.0, (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return math.exp((lo + hi) / 2)


def train(docs: DataFrame, learn: Column) -> Model:
    """A model from documents (doc_id, text, lang) for which `learn` holds and lang is known."""
    known = docs.filter(learn & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    per = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not per:
        return Model([], np.zeros((FEATURES, 0)), np.ones(FEATURES), np.zeros(0), 1.0)
    languages = sorted(per)
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    share = F.create_map(*[c for lang, m in per.items() for c in (F.lit(lang), F.lit(min(1.0, SAMPLE / m)))])[F.col("lang")]
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, langs in in_batches(2, 0, batches):
            rows = []
            for t, lang in zip(texts, langs):
                if has_letter(t):
                    found = counts(t)
                    at = np.flatnonzero(found)
                    x = found[at] * shared.value[at]
                    rows.append((lang, at, x / np.sqrt((x * x).sum())))
            out = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.float64()))], ["lang", "at", "x"])

    sample = mapped(known.filter(draw < share * 1_000_000).select("text", "lang"), vectors, "lang string, at array<int>, x array<double>")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort([[hash_of(x) for x in pdf["x"]], pdf["lang"]])]
        rows = [(np.append(at, FEATURES), np.append(x, 1.0), languages.index(lang)) for at, x, lang in zip(pdf["at"], pdf["x"], pdf["lang"])]
        apart = np.arange(len(rows)) % 5 == 4
        w, bias = ftrl([r for r, a in zip(rows, apart) if not a], len(languages))
        held = [r for r, a in zip(rows, apart) if a]
        logits = np.array([r[1][:-1] @ w[r[0][:-1]] + bias for r in held]).reshape(-1, len(languages))
        heat = best_temperature(logits, np.array([r[2] for r in held])) if held else 1.0
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        return pd.DataFrame({"bucket": [*used, FEATURES, FEATURES + 1], "w": [*w[used].tolist(), bias.tolist(), [heat]]})

    fitted = stored(sample.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fit, "bucket int, w array<double>")).collect()  # one row per bucket at most
    weights, bias, heat = np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0
    for bucket, w in fitted:
        if bucket == FEATURES:
            bias = np.array(w)
        elif bucket > FEATURES:
            heat = w[0]
        else:
            weights[bucket] = np.array(w) * idf[bucket]
    return Model(languages, weights, idf, bias, heat)


def hash_of(x: np.ndarray) -> float:
    return float(np.sum(np.asarray(x) * np.sin(np.arange(len(x)) + 1.0)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of documents (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            langs, scores = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, ~held_out)
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
