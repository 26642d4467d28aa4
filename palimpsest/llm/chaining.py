"""Substring duplicates by collinear chaining of shared k-mer seeds.

Words are ASCII-lower-cased runs of non-space. Equal word sequences are one text, represented by its
least id. Seeds are a text's minimizers: of every WINDOW consecutive K-word windows the one of least
hash, so any K + WINDOW - 1 equal words share a seed. All holders of a seed with at most SHARERS
places are matched with each other; a commoner one matches them with the least text that holds it, and
two more postings find what that leaves out. Every window of `least` words whose seeds are common is
posted by its hash and matched with the least text that holds the same window. So any `least` equal
words of two texts lead both of them to each other or to a third text with the same words.

Edited passages of common seeds are found by spans: two seeds of a text at most SPAN words apart, one
of them common. A holder of a span is represented by a lower one that has it in the same run of
windows. Those that nobody represents are all matched with each other: at once if they are at most
PAIRED, else first with the least text among them, and where no passage over the span comes of that,
with all others, whatever their number, in cells. Only spans of less than `least` words that more than
PAIRED hold stop at the least text, as an everyday line is no passage yet.

The matches of one pair of texts are chained: the best sequence that ascends in both, by length less
gap costs, through a Fenwick tree over positions in the second text. A chain of two matches or one
whole window is aligned on the words of both, between its anchors and outwards up to REACH words,
allowing short differences, and split at gaps over GAP words. An aligned passage of at least `least`
matching words is a duplicate, also with scattered edits.

Only slices of words around a pair's chains are brought together. Null and blank texts have no
words. Rows with equal ids are one document with several texts; rows without an id take no part. Equal
rows count once. Only doc_id and text are read, so further columns may have any names. Of equally good
chains the one that ends first is taken first. A table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, in_slices, mapped, read, stored, to_batch
from .near_dups import _hash, mixed

K, WINDOW, LEAST, SHARERS = 5, 10, 50, 4
GAP, GAP_COST, REACH, STEP = 24, 0.05, 128, 64
#: Most words from one seed of a span to the other; most holders that are all paired at once; and those of a cell.
SPAN, PAIRED, CELL = 72, 16, 1_024
_PRIMES = np.array([0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
#: Most ids that are sent to every executor; more are joined by a shuffle.
IDS_SENT = 1_000_000
PASSAGE = "doc_id long, begin long, end long, other_id long, other_begin long, other_end long, n_matched long"


def word_hashes(text: str | None) -> np.ndarray:
    return np.array([_hash[w] for w in (text or "").encode("utf-8", "surrogatepass").lower().split()], np.uint64)


def xxh64(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64, as of _hash, of many short pieces of bytes, of which each step takes all at once; those of over 31 one by one."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight, four = (np.ndarray(len(data) + 1 - np.dtype(t).itemsize, t, data, strides=(1,)) for t in ("<u8", "<u4"))
    h = _PRIMES[4] + sizes.astype(np.uint64)
    at = begins.copy()
    for size, lanes in ((8, eight), (8, eight), (8, eight), (4, four), (1, data), (1, data), (1, data)):
        i = np.flatnonzero(begins + sizes - at >= size)
        lane, mine = lanes[at[i]].astype(np.uint64), h[i]
        if size == 8:
            mine = _turned(mine ^ (_turned(lane * _PRIMES[1], 31) * _PRIMES[0]), 27) * _PRIMES[0] + _PRIMES[3]
        elif size == 4:
            mine = _turned(mine ^ (lane * _PRIMES[0]), 23) * _PRIMES[1] + _PRIMES[2]
        else:
            mine = _turned(mine ^ (lane * _PRIMES[4]), 11) * _PRIMES[0]
        h[i] = mine
        at[i] += size
    h = (h ^ (h >> np.uint64(33))) * _PRIMES[1]
    h = (h ^ (h >> np.uint64(29))) * _PRIMES[2]
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(sizes > 31):
        h[i] = xxhash.xxh64_intdigest(data[begins[i] : begins[i] + sizes[i]].tobytes())
    return h


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def hashed(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word_hashes of many texts in a row, and the bounds of each."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(bodies, "")))
    words = split.values
    data, sizes = np.frombuffer(words.buffers()[2] or b"", np.uint8), pc.binary_length(words).to_numpy().astype(np.int64)
    kept = sizes > 0
    return xxh64(data, (np.cumsum(sizes) - sizes)[kept], sizes[kept]), np.concatenate([[0], np.cumsum(kept)])[split.offsets.to_numpy()]


def spread(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts in a row with places between them that no window of two texts can bridge: words, which of them are real, and
    where each text begins."""
    begins = bounds[:-1] + (K + WINDOW) * np.arange(len(bounds) - 1)
    at = np.arange(len(h)) + np.repeat((K + WINDOW) * np.arange(len(bounds) - 1), np.diff(bounds))
    out, real = np.zeros(len(h) + (K + WINDOW) * len(begins), np.uint64), np.zeros(len(h) + (K + WINDOW) * len(begins), bool)
    out[at], real[at] = h, True
    return out, real, begins


def folded(h: np.ndarray, begins: np.ndarray, n: int) -> np.ndarray:
    """One hash of the n words from each of begins on."""
    total = np.full(len(begins), n, np.uint64)
    for i in range(n):
        total = mixed(total + h[begins + i])
    return total


def sampled_all(words: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text (number) and position of all minimizers of spread texts, by text and position."""
    n = sizes - K + 1
    held = np.flatnonzero(n > 0)
    if not len(held):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = folded(words, np.arange(len(words) - K + 1), K)
    edges = np.zeros(len(total) + 1, np.int64)  # places without K words of one text are never least
    np.add.at(edges, begins[held], 1)
    np.add.at(edges, begins[held] + n[held], -1)
    total[np.cumsum(edges)[:-1] == 0] = np.iinfo(np.uint64).max
    least, where, width = total, np.arange(len(total)), 1
    while width < WINDOW:
        step = min(width, WINDOW - width)
        later = least[step:] < least[:-step]
        least, where = np.where(later, least[step:], least[:-step]), np.where(later, where[step:], where[:-step])
        width += step
    windows = np.maximum(n[held] - WINDOW, 0) + 1
    first = np.concatenate([[0], np.cumsum(windows)[:-1]])
    at = where[np.arange(windows.sum()) + np.repeat(begins[held] - first, windows)]
    text = np.repeat(held, windows)
    kept = np.concatenate([[True], at[1:] != at[:-1]])
    at, text = at[kept], text[kept]
    return total[at], text, at - begins[text]


def sampled(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of all minimizers, by position."""
    words, _, begins = spread(h, np.array([0, len(h)]))
    found, _, at = sampled_all(words, begins, np.array([len(h)]))
    return found, at


def first_in_stretch(found: np.ndarray, at: np.ndarray, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes the first in each stretch of positions, as words that repeat have the same ones again and again."""
    order = np.lexsort((at, found))
    found, at = found[order], at[order]
    kept = np.concatenate([[True], (found[1:] != found[:-1]) | (at[1:] // stretch > at[:-1] // stretch)])
    return found[kept], at[kept]


def minimizers_all(h: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text (number) and position of the seeds of texts in a row; of equal ones of a text the first in each stretch of
    WINDOW positions."""
    words, real, begins = spread(h, bounds)
    found, text, at = sampled_all(words, begins, np.diff(bounds))
    order = np.argsort(found, kind="stable")
    found, text, at = found[order], text[order], at[order]
    kept = np.ones(len(found), bool)
    kept[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1]) | (at[1:] // WINDOW > at[:-1] // WINDOW)
    cycles = [cyclic(words, real, period, least) for period in range(1, 5)]
    found, places = (np.concatenate([x, *y]) for x, y in zip((found[kept], at[kept] + begins[text[kept]]), zip(*cycles)))
    text = np.concatenate([text[kept], np.searchsorted(begins, places[kept.sum() :], "right") - 1])
    return found, text, places - begins[text]


def minimizers(h: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of a text's seeds."""
    found, _, at = minimizers_all(h, np.array([0, len(h)]), least)
    return found, at


def windows_of(h: np.ndarray, common: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of each window of `least` words in which all minimizers but one at most are common seeds; of
    equal ones the first in each stretch of STEP positions."""
    n = len(h) - least + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found, at = sampled(h)
    rare = np.zeros(len(h) + 1, np.int64)
    np.add.at(rare, at[~np.isin(found, common)] + 1, 1)
    rare = np.cumsum(rare)
    begins = np.flatnonzero(rare[least - K + 1 : least - K + 1 + n] - rare[:n] <= 1)
    return first_in_stretch(folded(h, begins, least), begins, STEP) if len(begins) else (np.zeros(0, np.uint64), begins)


def spans_of(at: np.ndarray, seeds: np.ndarray, common: np.ndarray, runs: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """Key, both places (indexes) and owner of each span of two seeds, by ascending positions; of equal keys the first in each
    stretch of STEP positions. The owner is the least text of which a run (begin, end, text) holds the span, or -1. With
    WINDOW words of the run on both sides that text surely has the same seeds, and the span is left to it."""
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, len(at)):
        wide = at[d:] - at[:-d]
        if wide.min() > SPAN:
            break
        left = np.flatnonzero((wide <= SPAN) & (wide > 0) & (common[d:] | common[:-d]))
        pairs.append((left, left + d))
    i, j = (np.concatenate(x) for x in zip(*pairs))
    owner = np.full(len(i), np.iinfo(np.int64).max)
    mine = np.ones(len(i), bool)
    for begin, end, text in runs:
        inside = (begin <= at[i]) & (at[j] + K <= end)
        owner[inside] = np.minimum(owner[inside], text)
        mine &= ~((begin + WINDOW <= at[i]) & (at[j] + K + WINDOW <= end))
    owner[owner == np.iinfo(np.int64).max] = -1
    i, j, owner = i[mine], j[mine], owner[mine]
    if not len(i):
        return [np.zeros(0, np.uint64), i, j, owner]
    keys = mixed(mixed(seeds[i]) + seeds[j])
    order = np.lexsort((at[j], at[i], keys))
    i, j, keys, owner = i[order], j[order], keys[order], owner[order]
    kept = np.concatenate([[True], (keys[1:] != keys[:-1]) | (at[i[1:]] // STEP > at[i[:-1]] // STEP)])
    return [keys[kept], i[kept], j[kept], owner[kept]]


def cyclic(h: np.ndarray, real: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of stretches of at least `least` real words that repeat every `period` words: all such stretches of the same
    words hold one passage, though their plain seeds may lead to a text with a shorter stretch."""
    same = np.concatenate([[0], ((h[period:] == h[:-period]) & real[period:] & real[:-period]).astype(np.int8), [0]])
    begins, ends = np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1) + period
    long = ends - begins >= least
    begins = begins[long]
    names = np.array([mixed(mixed(h[i : i + period]).sum(keepdims=True) + np.uint64(period))[0] for i in begins], np.uint64)
    steps = np.arange(0, least - K, WINDOW)
    return np.repeat(names, len(steps)), (begins[:, None] + steps).ravel()


class Fenwick:
    """Greatest value, with its index, over prefixes of positions."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        """Over positions below i."""
        found = (-1e18, -1)
        while i > 0:
            found = max(found, self.best[i])
            i -= i & -i
        return found


def chains(a: np.ndarray, b: np.ndarray) -> list[list[tuple[int, int]]]:
    """Disjoint chains of matches (a, b), ascending in both, best first; a match scores K less GAP_COST a word between."""
    order = np.lexsort((-b, a))
    along, across = np.diff(a[order]), np.diff(b[order])
    if (along > 0).all() and (across > 0).all() and (GAP_COST * (along + across) < K).all():  # every match continues the one before
        return [list(zip(a[order].tolist(), b[order].tolist()))]
    places = {int(p): i for i, p in enumerate(np.unique(b))}
    tree, score, before = Fenwick(len(places)), [0.0] * len(order), [-1] * len(order)
    points = [(int(a[i]), int(b[i])) for i in order]
    for i, (x, y) in enumerate(points):
        best, j = tree.top(places[y])
        gain = best - GAP_COST * (x + y)
        score[i], before[i] = (K + gain, j) if j >= 0 and gain > 0 else (float(K), -1)
        tree.put(places[y], (score[i] + GAP_COST * (x + y), i))
    used, out = [False] * len(points), []
    for i in sorted(range(len(points)), key=lambda i: -score[i]):
        chain: list[tuple[int, int]] = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(points[i])
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


#: Words left out on both sides, fewest first.
JUMPS = [t for d in range(1, 5) for t in [(d, d)] + [(p, q) for e in range(d) for p, q in ((d, e), (e, d))]]


def run_on(x: Sequence[int], i: int, y: Sequence[int], j: int, step: int, credit: float = 0.0) -> tuple[int, int, int]:
    """Follows equal words from (i, j), over differences of up to four words after which three agree again; the
    last equal place and the number of equal words. Ends also where differences outweigh the equal words, of which
    `credit` lie before."""
    matched, at, n, m = 0, (i - step, j - step), len(x), len(y)
    while 0 <= i < n and 0 <= j < m:
        begin = i
        while 0 <= i < n and 0 <= j < m and x[i] == y[j]:
            i, j = i + step, j + step
        if i != begin:
            at, matched, credit = (i - step, j - step), matched + abs(i - begin), min(credit + abs(i - begin), 20.0)
            continue
        for p, q in JUMPS:
            u, v = i + step * p, j + step * q
            r, s = u + 2 * step, v + 2 * step
            if 0 <= u < n and 0 <= v < m and x[u] == y[v] and 0 <= r < n and 0 <= s < m and x[r] == y[s] and x[u + step] == y[v + step]:
                break
        else:
            break
        if credit < 2 * max(p, q):
            break
        credit -= 2 * max(p, q)
        i, j = u, v
    return (*at, matched)


def align(x: Sequence[int], y: Sequence[int], chain: list[tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Aligned passages (begin and end in x, begin and end in y, equal words) along a chain."""
    out: list[list[int]] = []
    for i, j in chain:
        if out and i < out[-1][1] and j < out[-1][3]:
            continue
        u, v, before = run_on(x, i - 1, y, j - 1, -1, K)
        p, q, after = run_on(x, i, y, j, 1)
        if out and u < out[-1][1] and v < out[-1][3] + 1:  # reached back into the passage before
            u, v, before = max(u, out[-1][1]), max(v, out[-1][3]), 0
        if out and max(i - out[-1][1], j - out[-1][3]) <= GAP:
            out[-1][1], out[-1][3], out[-1][4] = p + 1, q + 1, out[-1][4] + after
        else:
            out.append([u, p + 1, v, q + 1, before + after])
    return [tuple(o) for o in out]


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_words): text_key is a 128-bit digest of the word sequence."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in in_batches(2, 1, batches):
            split = [(t or "").encode("utf-8", "surrogatepass").lower().split() for t in bodies]
            yield to_batch(schema, [ids, [xxhash.xxh128_digest(b" ".join(s)) for s in split], [len(s) for s in split]])

    return mapped(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, text_key binary, n_words long")


def seeds(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(seed, doc_id, at) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies in in_slices(2, 1, batches):
            found, text, at = minimizers_all(*hashed(bodies), least)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), ids.take(pa.array(text)), pa.array(at.astype(np.int32))], ["seed", "doc_id", "at"])

    return mapped(docs.select("doc_id", "text"), run, "seed long, doc_id long, at int")


def window_links(docs: DataFrame, common: DataFrame, least: int) -> DataFrame:
    """(a, b, a_at, b_at, begins, run) of windows that two texts hold and whose seeds are common (doc_id, seeds): each text's
    with the least text's; all holders have the same words, so that one stands for them and none is left out. Windows
    that follow one another along both texts are a run, which begins with the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, bodies, seeds in in_slices(3, 1, batches):
            h, bounds = hashed(bodies)
            found = [windows_of(h[u:v], np.array(s.values).view(np.uint64), least) for u, v, s in zip(bounds[:-1], bounds[1:], seeds)]
            sizes = [len(w) for w, _ in found]
            columns = [np.concatenate([w for w, _ in found]).view(np.int64), np.repeat(ids.to_numpy(), sizes), np.concatenate([p for _, p in found]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["window", "doc_id", "at"])

    held = docs.join(common, "doc_id").select("doc_id", "text", "seeds")
    posted = stored(mapped(held, run, "window long, doc_id long, at int"))
    first = posted.groupBy("window").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last")).filter("first.doc_id < last")
    links = posted.join(first.select("window", "first"), "window").filter("doc_id <> first.doc_id")
    links = links.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("first.at").alias("a_at"), F.col("at").alias("b_at"))
    along = Window.partitionBy("a", "b", F.col("b_at") - F.col("a_at")).orderBy("b_at")
    links = links.withColumn("begins", F.coalesce(F.lag("b_at").over(along) < F.col("b_at") - 1, F.lit(True)))
    return stored(links.withColumn("run", F.sum(F.col("begins").cast("int")).over(along)))


def spans(places: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """(key, doc_id, at, to, owner, first_id, first_at, first_to) of the spans of places (doc_id, places): first_id,
    first_at, first_to are the places that lead both seeds, if they lie in one text."""
    runs = links.groupBy("a", "b", F.col("b_at") - F.col("a_at"), "run").agg(F.min("b_at").alias("begin"), (F.max("b_at") + least).alias("end"))
    runs = runs.groupBy(F.col("b").alias("doc_id")).agg(F.collect_list(F.struct("begin", "end", "a")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, bounds = batch.column(1), batch.column(1).offsets.to_numpy()
            at, seed, common, first, first_at = (points.values.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            at, seed = at.astype(np.int64), seed.view(np.uint64)
            found = [spans_of(at[u:v], seed[u:v], common[u:v], [(r["begin"], r["end"], r["a"]) for r in held or []]) for u, v, held in zip(bounds[:-1], bounds[1:], batch.column(2).to_pylist())]
            if found:
                keys, i, j, owners = (np.concatenate(c) for c in zip(*found))
                sizes = [len(f[0]) for f in found]
                i, j = (x + np.repeat(bounds[:-1], sizes) for x in (i, j))
                columns = (keys.view(np.int64), np.repeat(batch.column(0).to_numpy(), sizes), at[i].astype(np.int32), at[j].astype(np.int32), owners, np.where(first[i] == first[j], first[i], np.iinfo(np.int64).min), first_at[i], first_at[j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "doc_id", "at", "to", "owner", "first_id", "first_at", "first_to"])

    return stored(mapped(places.join(runs, "doc_id", "left").select("doc_id", "places", "runs"), run, "key long, doc_id long, at int, to int, owner long, first_id long, first_at int, first_to int"))


def meeting(links: DataFrame) -> DataFrame:
    """(a, b, a_at, b_at), a < b, of both ends of the spans that links (x, y: doc_id, at, to) bring together."""
    low, high = F.when(F.col("x.doc_id") < F.col("y.doc_id"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x.doc_id") < F.col("y.doc_id"), F.col("y")).otherwise(F.col("x"))
    links = links.filter("x.doc_id <> y.doc_id").select(low.alias("low"), high.alias("high"))
    ends = F.explode(F.array(*[F.struct(F.col(f"low.{k}").alias("a_at"), F.col(f"high.{k}").alias("b_at")) for k in ("at", "to")]))
    return links.select(F.col("low.doc_id").alias("a"), F.col("high.doc_id").alias("b"), ends.alias("m")).select("a", "b", "m.a_at", "m.b_at")


def span_matches(spans: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, a_at, b_at) of spans that two texts hold; and (key, me, centre, n) of the long ones whose n holders were
    only matched with the centre."""
    me = F.struct("doc_id", "at", "to").alias("me")
    sizes = spans.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).filter("low < high")
    held = stored(spans.join(sizes.select("key", "n"), "key"))
    few, many = held.filter(F.col("n") <= SHARERS).select("key", me), held.filter(F.col("n") > SHARERS)
    own = many.join(many.select("key", F.col("doc_id").alias("owner")).distinct(), ["key", "owner"], "left_anti").select("key", me, F.struct(F.col("first_id").alias("doc_id"), F.col("first_at").alias("at"), F.col("first_to").alias("to")).alias("first"))
    heads = own.groupBy("key").agg(F.count("*").alias("n"), F.min("me").alias("centre")).filter("n > 1")
    own = stored(own.join(heads, "key"))
    few = few.unionByName(own.filter(F.col("n") <= PAIRED).select("key", "me"))
    pairs = few.toDF("key", "x").join(few.toDF("key", "y"), "key").filter("x.doc_id < y.doc_id")
    broad = own.filter(F.col("n") > PAIRED)  # where the centre is the first place of both seeds, these have matched it
    star = broad.filter(F.col("centre") != F.col("first")).select(F.col("centre").alias("x"), F.col("me").alias("y"))
    return meeting(pairs.select("x", "y").unionByName(star)), broad.filter(F.col("me.to") - F.col("me.at") >= least - K).select("key", "me", "centre", "n")


def turned(passages: DataFrame) -> DataFrame:
    return passages.select(F.col("other_id").alias("doc_id"), F.col("other_begin").alias("begin"), F.col("other_end").alias("end"), F.col("doc_id").alias("other_id"), F.col("begin").alias("other_begin"), F.col("end").alias("other_end"), "n_matched")


def without(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """Pairs (x, y: doc_id, at, to) whose spans lie in no passage of both."""
    cover = [F.col("p.doc_id") == F.col("x.doc_id"), F.col("p.other_id") == F.col("y.doc_id"), F.col("p.begin") <= F.col("x.at"), F.col("x.to") + K <= F.col("p.end"), F.col("p.other_begin") <= F.col("y.at"), F.col("y.to") + K <= F.col("p.other_end")]
    return pairs.join(passages.unionByName(turned(passages)).alias("p"), cover, "left_anti")


def _alike(least: int):
    """Pairs of one cell, (x of the left, y of the right), that can hold a passage: `least` words of the right lie in three words
    in a row that the left has too, as all words that an alignment counts lie in runs of three at least; and both ends
    of the span are near enough for a chain, or the two texts have further matches, by another key that either is alone
    with or by a key again."""

    def run(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[("left", "descending")]))
        me, lone, n_left = table["me"], table["alone"].to_numpy(), pc.sum(table["left"]).as_py() or 0
        doc = pc.struct_field(me, "doc_id").to_numpy()
        words = [np.frombuffer(w, np.uint32) for w in table["words"].to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        codes = folded(np.concatenate([*words, np.zeros(2, np.uint32)]).astype(np.uint64), np.arange(bounds[-1]), 3)
        keys = [np.unique(k.values) for k in table["keys"]]
        again = pc.list_value_length(table["keys"]).to_numpy() > [len(k) for k in keys]
        lone_keys = np.concatenate([np.isin(k, u.values) for k, u in zip(keys, table["lone"])]).astype(np.int8)
        wide = pc.subtract(pc.struct_field(me, "to"), pc.struct_field(me, "at")).to_numpy()
        key_at = np.cumsum([0, *[len(k) for k in keys]])
        named, codes = np.unique(codes, return_inverse=True)
        kinds, keys = np.unique(np.concatenate(keys), return_inverse=True)
        for i in (1, 2):
            codes[bounds[1:] - i] = len(named)  # none: three words of two texts
        right, begins, held = codes[bounds[n_left] :], bounds[n_left:-1] - bounds[n_left], np.zeros(len(named) + 1, bool)
        right_keys, key_begins, common = keys[key_at[n_left] :], key_at[n_left:-1] - key_at[n_left], np.zeros(len(kinds), np.int8)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(n_left if len(begins) else 0):
            mine = codes[bounds[i] : bounds[i + 1] - 2]
            held[mine] = True
            hit = held[right]
            covered = hit.copy()
            covered[1:] |= hit[:-1]
            covered[2:] |= hit[:-2]
            found = np.add.reduceat(covered, begins, dtype=np.int64) >= least
            common[keys[key_at[i] : key_at[i + 1]]] = 1 + lone_keys[key_at[i] : key_at[i + 1]]
            found &= (np.add.reduceat(common[right_keys] + lone_keys[key_at[n_left] :] > 1, key_begins, dtype=np.int64) > 1) | (GAP_COST * (wide[i] + wide[n_left:]) <= K) | again[i] | again[n_left:]
            common[keys[key_at[i] : key_at[i + 1]]] = 0
            y.append(n_left + np.flatnonzero(found & (doc[n_left:] != doc[i]) & (~lone[n_left:] | (doc[i] < doc[n_left:]))))
            x.append(np.full(len(y[-1]), i))
            held[mine] = False
        return pa.Table.from_arrays([me.take(pa.array(np.concatenate(side))) for side in (x, y)], ["x", "y"])

    return run


def apart(docs: DataFrame, broad: DataFrame, passages: DataFrame, least: int) -> DataFrame:
    """(x, y) of the holders of one span to compare yet: those without a passage over it with its centre, each with all others.
    Cells of CELL holders a side meet as wholes, with their words about the span, and only pairs that can hold a passage
    leave them. A passage has K matched words in every GAP + K at least, so if it ends beyond `near` words from the
    span, `least` of them lie within."""
    others = broad.filter(F.col("me") != F.col("centre"))
    alone = stored(without(others.select("key", F.col("centre").alias("x"), F.col("me").alias("y")), passages).select("key", F.col("y").alias("me")))
    lefts = alone.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("lefts"))
    held = others.join(lefts, "key").join(alone.withColumn("alone", F.lit(True)), ["key", "me"], "left").select("key", "me", F.coalesce("alone", F.lit(False)).alias("alone"), "lefts", F.ceil(F.col("n") / CELL).cast("int").alias("rights"))
    held = stored(held)
    near = (least + K) * (GAP + K) // K + 4
    low = F.greatest(F.lit(0), F.col("me.at") - near)
    keys = stored(held.groupBy("me.doc_id").agg(F.collect_list("key").alias("keys"), F.collect_set(F.when(F.col("alone"), F.col("key"))).alias("lone")))
    texts = worded(docs, keys.select("doc_id")).join(keys, "doc_id").withColumnRenamed("doc_id", "id")
    held = held.join(texts, F.col("me.doc_id") == F.col("id")).withColumn("words", F.substring("words", 4 * low + 1, 4 * (F.col("me.to") + K + near - low)))
    held = held.filter(F.length("words") >= 4 * K)  # shorter only where an id has several texts
    dealt = lambda cells: F.pmod(F.xxhash64("me"), cells).cast("int")
    as_right = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(F.lit(False).alias("left"), i.alias("i"), dealt("rights").alias("j")))
    as_left = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda j: F.struct(F.lit(True).alias("left"), dealt("lefts").alias("i"), j.alias("j")))
    cells = held.select("key", "me", "alone", "words", "keys", "lone", F.explode(F.when(F.col("alone"), F.concat(as_right, as_left)).otherwise(as_right)).alias("cell"))
    cells = cells.select("key", "cell.i", "cell.j", "cell.left", "me", "alone", "words", "keys", "lone")
    place = "struct<doc_id: long, at: int, to: int>"
    return without(cells.groupBy("key", "i", "j").applyInArrow(_alike(least), f"x {place}, y {place}"), passages)


def matches(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(a, b, a_at, b_at, whole) of equal seeds and spans, and of equal windows, which are whole; and the spans that span_matches leaves."""
    found = stored(seeds(docs, least))
    places = found.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).filter("first.doc_id < last")
    shared = stored(found.join(places.drop("last"), "seed"))
    few, many = shared.filter(F.col("n") <= SHARERS).select("seed", "doc_id", "at"), shared.filter(F.col("n") > SHARERS)
    left, right = few.toDF("seed", "a", "a_at"), few.toDF("seed", "b", "b_at")
    pairs = left.join(right, "seed").filter("a < b").select("a", "b", "a_at", "b_at")
    star = many.filter("doc_id <> first.doc_id").select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("first.at").alias("a_at"), F.col("at").alias("b_at"))
    listed = shared.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "seed", (F.col("n") > SHARERS).alias("common"), F.col("first.doc_id").alias("first_id"), F.col("first.at").alias("first_at")))).alias("places"))
    near = F.zip_with(F.slice("places", 2, F.size("places")), F.slice("places", 1, F.size("places") - 1), lambda later, one: (later["at"] - one["at"] <= SPAN) & (later["common"] | one["common"]))
    listed = stored(listed.filter(F.exists(near, lambda x: x)))
    often = F.filter("places", lambda p: p["common"])
    close = F.zip_with(F.slice("often", 2, F.size("often")), F.slice("often", 1, F.size("often") - 1), lambda later, one: later["at"] - one["at"] <= least - K)
    common = listed.filter(F.exists("places", lambda p: p["common"])).select("doc_id", often.alias("often")).filter(F.exists(close, lambda x: x))  # a window has two such places at least
    links = window_links(docs, common.select("doc_id", F.array_distinct(F.col("often.seed")).alias("seeds")), least)
    spanned, broad = span_matches(spans(listed, links, least), least)
    whole = links.filter(F.col("begins") | (F.col("b_at") % STEP == 0)).select("a", "b", "a_at", "b_at")
    return pairs.unionByName(star).unionByName(spanned).withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True))), broad


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of each pair's matches, but those of one seed alone."""
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        lists = batch.column(2)
        x, y, whole = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        bounds = lists.offsets.to_numpy()
        for a, b, begin, end in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), bounds[:-1], bounds[1:]):
            sure = {(int(x[i]), int(y[i])) for i in range(begin, end) if whole[i]}
            for chain in chains(x[begin:end], y[begin:end]):
                if len(chain) > 1 or chain[0] in sure:
                    for column, value in zip(out, (a, b, [p for p, _ in chain], [q for _, q in chain])):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["a", "b", "a_at", "b_at"])


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                a, b, a_at, b_at, a_from, b_from, x, y = (batch.column(i)[r] for i in range(8))
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                i, j = a_from.as_py(), b_from.as_py()
                chain = [(p - i, q - j) for p, q in zip(a_at.as_py(), b_at.as_py())]
                x, y = x.tolist(), y.tolist()
                rows += [(a.as_py(), u + i, v + i, b.as_py(), p + j, q + j, n) for u, v, p, q, n in align(x, y, chain) if n >= least]
            columns = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "begin", "end", "other_id", "other_begin", "other_end", "n_matched"])

    return run


def sent(ids: DataFrame) -> DataFrame:
    """A stored table of ids, to be broadcast if it is small enough."""
    return F.broadcast(ids) if ids.count() <= IDS_SENT else ids


def worded(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, words) of the texts with the stored ids; a word is the lower four bytes of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, bodies in in_slices(2, 1, batches):
            h, bounds = hashed(bodies)
            words = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(h.astype("<u4"))])
            yield pa.RecordBatch.from_arrays([held, words], ["doc_id", "words"])

    return mapped(docs.join(sent(ids), "doc_id", "left_semi"), run, "doc_id long, words binary")


def aligned(docs: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """Passages of the pairs of texts with the matches found (a, b, a_at, b_at, whole)."""
    grouped = found.groupBy("a", "b").agg(F.collect_set(F.struct("a_at", "b_at", "whole")).alias("matches"))
    several = (F.size("matches") > 1) | F.exists("matches", lambda m: m["whole"])
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes take long to chain
    linked = stored(mapped(grouped.filter(several).select("a", "b", "matches").repartition(parts), _chain, "a long, b long, a_at array<int>, b_at array<int>"))
    needed = stored(linked.select(F.col("a").alias("doc_id")).union(linked.select("b")).distinct())

    held = worded(docs, needed)

    def slices(frame: DataFrame, side: str) -> DataFrame:
        low = F.greatest(F.lit(0), F.array_min(f"{side}_at") - REACH)
        part = F.substring("words", 4 * low + 1, 4 * (F.array_max(f"{side}_at") + K + REACH - low))
        return frame.join(held.withColumnRenamed("doc_id", side), side).withColumn(f"{side}_from", low).withColumn(f"{side}_words", part).drop("words")

    both = slices(slices(linked, "a"), "b").select("a", "b", "a_at", "b_at", "a_from", "b_from", "a_words", "b_words")
    return stored(mapped(both.repartition(parts), _align(least), PASSAGE))


def repeated_passages(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Passages of at least `least` words that a text shares with another: doc_id, begin, end (words, end exclusive),
    other_id, other_begin, other_end, n_matched. Both texts of a pair have rows; a copy has a row with its class's
    least id, which stands for its other passages, and that one with the greatest."""
    docs = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    keyed = stored(texts(docs))
    classes = stored(keyed.filter("n_words > 0").groupBy("text_key").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.max("n_words").alias("n_words")))
    copies = keyed.join(classes.filter((F.col("rep") < F.col("last")) & (F.col("n_words") >= least)).drop("n_words"), "text_key")
    other = F.when(F.col("doc_id") == F.col("rep"), F.col("last")).otherwise(F.col("rep"))
    whole = copies.select("doc_id", F.lit(0).cast("long").alias("begin"), F.col("n_words").alias("end"), other.alias("other_id"), F.lit(0).cast("long").alias("other_begin"), F.col("n_words").alias("other_end"), F.col("n_words").alias("n_matched"))

    again = stored(keyed.join(classes.select("text_key", "rep"), "text_key").filter("doc_id <> rep").select("doc_id").distinct())
    single = docs.join(sent(again), "doc_id", "left_anti")
    found, broad = matches(single, least)
    passages = aligned(docs, found, least)
    rest = stored(meeting(apart(docs, broad, passages, least)))
    if not rest.isEmpty():
        passages = passages.unionByName(aligned(docs, rest.withColumn("whole", F.lit(False)), least))
    return whole.unionByName(passages).unionByName(turned(passages)).distinct()


def op8_substring_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))
