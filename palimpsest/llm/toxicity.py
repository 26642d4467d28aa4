"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols (insult, threat, target, negation, report, other). Four small transducers read
a clause's symbols and are composed into one machine: the target transducer marks insults and threats
that are aimed at someone, the negation transducer marks what a negation just before governs, the
report transducer what quoted speech holds. The machine's output for each matched clause adds the
matched word's weight to the feature of its reading (plain, aimed, negated, reported); a logistic
model over the features gives the score. So a word counts by the clause that it stands in.

Insults are learned: words whose distinct contexts (word before, word after) are far commoner in
toxic than in clean rows, which copies of one text cannot fake, beside SEEDS. Learning uses at most
about SAMPLE labelled rows of each label, whole texts; every row is scored.

Null and empty texts have no clause and get the score of a text without matches. Several labels of
one id count as toxic if any does. Rows with equal or null ids are scored one by one, equal texts alike. A column named
score is replaced; others stay, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, in_batches, mapped, read, stored

SAMPLE = 8_000
SUPPORT, ODDS = 8, 9.0
SEEDS = "idiot moron stupid loser scum trash pathetic disgusting worthless clown".split()
SYMBOLS = {
    "threat": "kill hurt destroy beat stab shoot strangle töten schlagen umbringen tuer frapper matar golpear",
    "target": "you your youre he she they him her them du dich ihr sie er tu te vous il elle ils tú usted él ella ellos",
    "negation": "not never no isnt arent wasnt cannot nicht nie kein keine ne pas jamais nunca jamás",
    "report": "said says wrote called claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
READINGS = ("plain", "aimed", "negated", "reported")
CLAUSE_END = b".!?;\n"
TABLE = bytes(10 if b in CLAUSE_END else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))


def clauses_of(text: str | None) -> bytes:
    """Lower-cased words between spaces, clauses between line ends."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(TABLE)


@dataclass
class Transducer:
    """arcs: (state, symbol) to (state, symbol written); any other symbol is copied and leads to `rest`."""

    arcs: dict[tuple, tuple]
    rest: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str) -> tuple:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def compose(first: Transducer, second: Transducer, alphabet: set[str]) -> Transducer:
    """The machine that reads what first reads and writes what second makes of first's output."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in alphabet:
            a, written = first.step(state[0], symbol)
            b, written = second.step(state[1], written)
            arcs[state, symbol] = ((a, b), written)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return Transducer(arcs, start=start)


def within(cue: str, reach: int, marks: dict[str, str]) -> Transducer:
    """Rewrites symbols by marks for `reach` symbols after a cue."""
    arcs = {(state, cue): (reach, cue) for state in range(reach + 1)}
    arcs |= {(state, old): (state - 1, new) for state in range(1, reach + 1) for old, new in marks.items()}
    return Transducer(arcs, {state: state - 1 for state in range(1, reach + 1)})


def grammar() -> Transducer:
    match = Transducer({(0, "insult"): (0, "plain"), (0, "threat"): (1, "threat"), (1, "target"): (0, "aimed"), (1, "insult"): (0, "aimed")}, {1: 0})
    alphabet = {"insult", "other", *SYMBOLS}
    machine = compose(match, within("target", 4, {"plain": "aimed"}), alphabet)
    machine = compose(machine, within("negation", 3, {"plain": "negated", "aimed": "negated"}), alphabet)
    return compose(machine, within("report", 12, {"plain": "reported", "aimed": "reported"}), alphabet)


_arcs: dict = {}


class Scorer:
    def __init__(self, weights: dict[bytes, float]) -> None:
        self.weights = weights
        self.symbols = {w.encode(): s for s, of in SYMBOLS.items() for w in of.split()} | dict.fromkeys(weights, "insult")
        self.cues = set(weights) | {w.encode() for w in SYMBOLS["threat"].split()}

    def features(self, text: str | None) -> list[float]:
        """log1p of the weight of each reading, of the number of distinct matched words and of matched clauses per clause."""
        held = clauses_of(text)
        if self.cues.isdisjoint(held.split()):
            return [0.0] * (len(READINGS) + 2)
        if not _arcs:
            machine = grammar()
            _arcs.update(machine.arcs)
            _arcs["start"] = machine.start
        total, words, matched, n = dict.fromkeys(READINGS, 0.0), set(), 0, 0
        for clause in held.split(b"\n"):
            tokens = clause.split()
            n += bool(tokens)
            if self.cues.isdisjoint(tokens):
                continue
            state, hit = _arcs["start"], False
            for token in tokens:
                state, written = _arcs[state, self.symbols.get(token, "other")]
                if written in total:
                    total[written] += self.weights.get(token, 2.0)
                    words.add(token)
                    hit = True
            matched += hit
        return [*(math.log1p(total[r]) for r in READINGS), math.log1p(len(words)), math.log1p(100 * matched / max(n, 1))]


@dataclass
class Model:
    weights: dict[bytes, float]
    betas: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        scorer = Scorer(self.weights)
        x = np.array([scorer.features(t) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(self.betas[0] + x @ self.betas[1:], -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weighted logistic regression with a ridge on all but the intercept, by damped Newton steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - penalty @ beta
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        beta += step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, learn: Column, size: int = SAMPLE) -> DataFrame:
    """(toxic, share, text): about `size` rows of each label at most, by a hash of the id; share is the part taken."""
    known = labels.filter(learn & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    shares = {k: min(1.0, size / n) for k, n in counts.items()}
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(v)) for k, v in shares.items()], F.lit(0.0))
    drawn = known.withColumn("share", share).filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    return docs.join(F.broadcast(drawn), "doc_id").select("toxic", "share", "text")  # the sample's size is bounded


def learn_words(sample: DataFrame) -> dict[bytes, float]:
    """Log-odds of words whose distinct contexts tell toxic from clean rows."""
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    seeds = {w.encode(): 3.0 for w in SEEDS}
    if not n.get(0) or not n.get(1):
        return seeds
    rate = n[0] / n[1]
    support = min(SUPPORT, max(4, n[1] // 50))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: tuple[Counter, Counter] = (Counter(), Counter())
        for toxic, texts in in_batches(2, 1, batches):
            for y, t in zip(toxic, texts):
                rows[y].update(set(clauses_of(t).split()))
        words = [w for w in rows[0].keys() | rows[1].keys()]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([rows[1][w] for w in words], pa.int64()), pa.array([rows[0][w] for w in words], pa.int64())], ["word", "bad", "good"])

    counted = mapped(sample.select("toxic", "text"), count, "word binary, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    telling = lambda frame: frame.filter((F.col("bad") >= support) & (F.col("bad") * rate >= ODDS * (F.col("good") + 0.5)))
    wanted = {bytes(r["word"]) for r in telling(counted).select("word").collect()}  # words of the bounded sample

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for toxic, texts in in_batches(2, 1, batches):
            rows = set()
            for y, t in zip(toxic, texts):
                tokens = [b"", *clauses_of(t).split(), b""]
                if not wanted.isdisjoint(tokens):
                    rows |= {(w, tokens[i] + b" " + tokens[i + 2], y) for i, w in enumerate(tokens[1:-1]) if w in wanted}
            out = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32())], ["word", "context", "toxic"])

    seen = mapped(sample.select("toxic", "text"), contexts, "word binary, context binary, toxic int").distinct()
    counted = seen.groupBy("word").agg(F.sum(F.col("toxic")).alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    kept = telling(counted).orderBy("word").collect()
    return seeds | {bytes(r["word"]): math.log((r["bad"] + 0.5) * rate / (r["good"] + 0.5)) for r in kept}


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> Model:
    """Learns words and the logistic model from labelled rows for which `learn` (over doc_id) holds."""
    sample = stored(labelled_sample(docs.select("doc_id", "text"), labels, learn))
    weights = learn_words(sample)
    width = len(READINGS) + 2

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for toxic, share, texts in in_batches(3, 2, batches):
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(share, pa.float64()), pa.array([scorer.features(t) for t in texts], pa.list_(pa.float64()))], ["toxic", "share", "x"])

    rows = mapped(sample, measure, "toxic int, share double, x array<double>").collect()
    if not rows:
        return Model(weights, np.array([-2.0, *[1.0] * width]))
    y = np.array([r["toxic"] for r in rows], float)
    beta = logistic(np.array([r["x"] for r in rows]), y, 1 / np.array([r["share"] for r in rows]))
    return Model(weights, beta)


def score(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """docs with score, between 0 and 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep_text or i != at]
    fields = ", ".join(f"`{docs.columns[i]}` {docs.schema[i].dataType.simpleString()}" for i in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [s for (texts,) in in_batches(1, 0, [batch.select([at])]) for s in shared.value.scores(texts)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(scores, pa.float64())], [*[batch.schema.names[i] for i in kept], "score"])

    return mapped(docs, run, f"{fields}, score double")


def model_for(spark: SparkSession, sf_dir: str) -> Model:
    learn = fold_of(F.col("doc_id"), 5) != 0
    return train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), learn)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = score(docs, model_for(spark, sf_dir), keep_text=False)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
