"""Ranked lexical search by a threshold-seeded join.

A term is a maximal run of ASCII letters and digits and of characters beyond ASCII, with A-Z lower-cased. N documents
have a term, L is the sum of their lengths; a term held by df documents weighs w = floor(1000 ln((2N+2)/(2df+1))), and its
impact on a document of n terms that holds it tf times is w * ((10^9 tf) div (1000 tf + 8m)), m = 10 + (90 n N) div L. A
document's score for an item is the sum of the impacts of the item's terms, once each.

Documents are read once into postings of the items' terms. For each term the k documents of highest impact are stored. An
item's kth score is at least the kth impact of any of its terms, and at least the kth of the exact scores of the stored
documents of its terms: the larger of the two is its threshold. In ascending order of their highest impacts an
item's terms are pruned as long as these add up to less than the threshold: no document with pruned terms alone can
reach it. The join of postings and items runs over the other terms only, mostly the rare ones; what it adds up, with the bound of
the pruned terms, must reach the threshold for a document to be a candidate. Candidates are scored exactly and ranked.

Rows of documents are documents of their own, repeated or not; rows of items with one id are one item with the terms of
all. Rows without an id take no part. A null text has no terms. Equal scores are ranked by doc_id, then by row. Without
documents, items or common terms there are no rows. Only the ids and texts are read, so further columns may have any names; texts
are read whole, of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, mapped, read, stored, to_batch

K = 10
#: Most terms, and most rows of a table, that are sent to every executor; more are joined by a shuffle.
TERMS_SENT, ROWS_SENT = 200_000, 1_000_000
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[str]:
    return [t.decode() for t in _TERM.findall((text or "").encode().lower())]


def sent(frame: DataFrame) -> DataFrame:
    """A stored frame, marked for broadcast if it is counted small."""
    return F.broadcast(frame) if frame.count() <= ROWS_SENT else frame


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), distinct."""
    schema = pa.schema([("item_id", pa.int64()), ("terms", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            yield to_batch(schema, [ids, [sorted(set(terms(t))) for t in texts]])

    held = mapped(items.select(F.col("item_id").cast("long"), "text").filter("item_id is not null"), run, "item_id long, terms array<string>")
    return held.select("item_id", F.explode("terms").alias("term")).distinct()


def index(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(row, doc_id, n, tf): each document's number of terms, and how often it holds each term of `asked` (term)."""
    few = asked.limit(TERMS_SENT + 1).collect()
    known = docs.sparkSession.sparkContext.broadcast({r["term"].encode() for r in few}) if len(few) <= TERMS_SENT else None
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("tf", pa.map_(pa.string(), pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            lengths, maps = [], []
            for text in texts:
                found = _TERM.findall((text or "").encode().lower())
                counts = Counter(found)
                kept = counts if known is None else counts.keys() & known.value
                lengths.append(len(found))
                maps.append([(t.decode(), counts[t]) for t in sorted(kept)])
            yield to_batch(schema, [ids, lengths, maps])

    held = mapped(docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null"), run, "doc_id long, n long, tf map<string,bigint>")
    return held.select(F.monotonically_increasing_id().alias("row"), "*")


def postings(held: DataFrame, weights: DataFrame, documents: int, length: int) -> DataFrame:
    """(term, row, doc_id, impact) of an index, for the terms of `weights` (term, w)."""
    m = F.expr(f"10 + ({90 * documents}L * n) div {length}L")
    each = held.select("row", "doc_id", m.alias("m"), F.explode("tf").alias("term", "tf"))
    return each.join(weights, "term").select("term", "row", "doc_id", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("impact"))


def scored(pairs: DataFrame, held: DataFrame, wanted: DataFrame, weights: DataFrame, documents: int, length: int) -> DataFrame:
    """(item_id, row, doc_id, score): exact scores of pairs (item_id, row)."""
    pairs = stored(pairs)
    some = held.join(sent(stored(pairs.select("row").distinct())), "row", "left_semi")
    each = postings(some, weights, documents, length).join(sent(pairs), "row").join(wanted, ["item_id", "term"])
    return each.groupBy("item_id", "row", "doc_id").agg(F.sum("impact").alias("score"))


def thresholds(wanted: DataFrame, strongest: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(item_id, threshold): a lower bound of the item's kth score, 0 where none is known."""
    single = wanted.join(strongest.filter(F.col("place") == k), "term").groupBy("item_id").agg(F.max("impact").alias("bound"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"))
    seeded = seeds.withColumn("place", F.row_number().over(order)).filter(F.col("place") == k).select("item_id", F.col("score").alias("bound"))
    found = single.unionByName(seeded).groupBy("item_id").agg(F.max("bound").alias("threshold"))
    return wanted.select("item_id").distinct().join(found, "item_id", "left").select("item_id", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def split_terms(wanted: DataFrame, strongest: DataFrame, bounds: DataFrame) -> DataFrame:
    """(item_id, term, pruned, rest, threshold): whether the join leaves a term out, and the most that the item's pruned
    terms can add to a score."""
    highest = strongest.filter("place = 1").select("term", F.col("impact").alias("most"))
    rising = Window.partitionBy("item_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    each = wanted.join(highest, "term").join(bounds, "item_id").withColumn("pruned", F.sum("most").over(rising) < F.col("threshold"))
    rest = F.sum(F.when(F.col("pruned"), F.col("most")).otherwise(0)).over(Window.partitionBy("item_id"))
    return each.select("item_id", "term", "pruned", rest.alias("rest"), "threshold")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score above 0 for each item (item_id, text)."""
    wanted = stored(item_terms(items))
    held = stored(index(docs, wanted.select("term").distinct()))
    sizes = held.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    documents, length = sizes[0], max(sizes[1] or 0, 1)
    df = held.select(F.explode(F.map_keys("tf")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    weights = sent(stored(df.select("term", weight.cast("long").alias("w"))))
    wanted = sent(wanted)
    order = Window.partitionBy("term").orderBy(F.desc("impact"), "row")
    strongest = postings(held, weights, documents, length).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    strongest = stored(strongest.select("term", "row", "place", "impact"))
    seeds = scored(wanted.join(strongest, "term").select("item_id", "row").distinct(), held, wanted, weights, documents, length)
    split = stored(split_terms(wanted, strongest, thresholds(wanted, strongest, seeds, k)))
    kept = sent(stored(split.filter("not pruned").select("item_id", "term")))
    bounds = sent(stored(split.select("item_id", "rest", "threshold").distinct()))
    summed = postings(held, weights, documents, length).join(kept, "term").groupBy("item_id", "row").agg(F.sum("impact").alias("score"))
    candidates = summed.join(bounds, "item_id").filter("score + rest >= threshold").select("item_id", "row")
    best = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id", "row")
    exact = scored(candidates, held, wanted, weights, documents, length).filter("score > 0")
    return exact.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), K)
