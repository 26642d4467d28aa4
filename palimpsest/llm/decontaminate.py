"""Benchmark decontamination with an FM-index per shard of training documents.

Words are runs of ASCII digits and letters (lower-cased) and of any non-ASCII characters. A test
phrase is a window of `width` consecutive words of a benchmark item, or all words of a shorter one.
A task indexes its documents shard by shard: only words that some phrase holds can take part in an
occurrence, so a shard's text is its runs of such words at least as long as the shortest phrase.
Phrases are searched backwards, occurrences located, and their word spans merged per document.

Items are dealt by hash into blocks of about BLOCK_CHARS characters, which reach the tasks by broadcast; one pass
over the texts follows another in the same stage, without a shuffle, however many blocks there are.

A null text, document or item, has no words; an item without an id takes part, but has no id to
report. Rows with equal ids are judged one by one, repeated rows too. Columns named like a result are replaced. A table without
documents gives no rows, one without items no spans.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_CHARS, mapped, read
from .fm_index import FMIndex

WIDTH, BLOCK_CHARS = 10, 8_000_000
RESULT = "n_words long, spans array<struct<begin:long,end:long>>, items array<string>"
TABLE = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Phrases:
    """Distinct phrases of a block of items, by length, as rows of symbols from 1."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int) -> None:
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.symbols.setdefault(w, len(self.symbols) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found[tuple(ids[i : i + width])].update([item] if item is not None else [])
        self.by_length: list[tuple[np.ndarray, list[list[str]]]] = []
        for n in sorted({len(p) for p in found}):
            of = [p for p in found if len(p) == n]
            self.by_length.append((np.array(of, np.int64), [sorted(found[p]) for p in of]))
        self.shortest = self.by_length[0][0].shape[1] if found else 0

    def search(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Occurrences in a shard: text number, first word, length, items."""
        none = np.zeros(0, np.int64)
        sizes = np.array([len(t) for t in texts], np.int64)
        get = self.symbols.get
        symbols = np.fromiter((get(w, 0) for t in texts for w in t), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        if not self.by_length or not len(symbols):
            return none, none, none, []
        known = symbols > 0
        starts = known & np.concatenate([[True], ~known[:-1] | (doc[1:] != doc[:-1])])
        ends = known & np.concatenate([~known[1:] | (doc[1:] != doc[:-1]), [True]])
        first, last = np.flatnonzero(starts), np.flatnonzero(ends)
        long = last - first + 1 >= self.shortest
        first, length = first[long], (last - first + 1)[long]
        if not len(first):
            return none, none, none, []
        offsets = np.concatenate([[0], np.cumsum(length)])
        kept = np.repeat(first - offsets[:-1], length) + np.arange(offsets[-1])
        index = FMIndex(symbols[kept], offsets[:-1], len(self.symbols))
        at, size, items = [], [], []
        for patterns, of in self.by_length:
            low, high = index.find(patterns)
            n = high - low
            hits = np.flatnonzero(n)
            rows = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(n[hits])])[:-1], n[hits]) + np.arange(n[hits].sum())
            found = index.locate(rows)
            run = np.searchsorted(index.run_starts, found, "right") - 1
            at.append(first[run] + found - index.run_starts[run])
            size.append(np.full(len(found), patterns.shape[1]))
            items += [of[i] for i in np.repeat(hits, n[hits])]
        begin = np.concatenate(at)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return doc[begin], begin - before[doc[begin]], np.concatenate(size), items


def merged(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[dict[str, int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"begin": begin, "end": end})
    return out


def _shards(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    begin, size, texts = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py()
        if texts and size + len(text or "") > CHUNK_CHARS:
            yield begin, texts
            begin, size, texts = i, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield begin, texts


def _pass(phrases, text_at: int, spans_at: int | None, drop: list[int]):
    """One block's pass: appends n_words, spans, items, or adds to those at spans_at and after."""
    types = [pa.int64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Phrases = phrases.value
        for batch in batches:
            n_words: list[int] = []
            spans: list[list[tuple[int, int]]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for begin, texts in _shards(batch.column(text_at)):
                distinct: dict[str | None, int] = {}
                which = [distinct.setdefault(t, len(distinct)) for t in texts]
                split = [words(t) for t in distinct]
                of: list[list[int]] = [[] for _ in split]
                for i, k in enumerate(which):
                    of[k].append(begin + i)
                    n_words.append(len(split[k]))
                for k, at, size, found in zip(*block.search(split)):
                    for i in of[k]:
                        spans[i].append((int(at), int(at + size)))
                        items[i].update(found)
            if spans_at is not None:
                for old, new in zip(batch.column(spans_at).to_pylist(), spans):
                    new += [(s["begin"], s["end"]) for s in old]
                for old, held in zip(batch.column(spans_at + 1).to_pylist(), items):
                    held.update(old)
            added = [pa.array(n_words, types[0]), pa.array([merged(s) for s in spans], types[1]), pa.array([sorted(s) for s in items], types[2])]
            names = batch.schema.names
            kept = [i for i in range(batch.num_columns if spans_at is None else spans_at - 1) if i not in drop]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + added, [names[i] for i in kept] + ["n_words", "spans", "items"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, keep_text: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs with n_words, spans (merged word spans to remove, end exclusive) and items (ids as sorted strings)."""
    docs = docs.drop("n_words", "spans", "items")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    text_at = docs.columns.index("text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // block_chars) or 1
    for k in range(blocks):
        of = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases([tuple(r) for r in of.collect()], width))
        last = k == blocks - 1
        drop = [] if keep_text or not last else [text_at]
        schema = ", ".join([f for i, f in enumerate(fields) if i not in drop] + [RESULT])
        docs = mapped(docs, _pass(phrases, text_at, len(fields) + 1 if k else None, drop), schema)
    return docs


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )
