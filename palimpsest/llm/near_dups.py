"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set is its distinct five-word shingles (lower-cased ASCII, words between ASCII white
space; fewer words are one shingle). Equal sets are one class, represented by its least id. A
signature has COORDINATES minima; two sets at the similarity bound of `percent` agree in fewer than
matches(percent) of them with a chance of at most CHANCE.

Classes are posted under (coordinate, value). Pairs with that many common postings must meet in a
class's `held - matches + 1` rarest shared postings, so only those prefixes are joined, and values
of one class post nothing. In each list the agreeing coordinates of whole signatures are counted,
pairs whose sizes rule them out are skipped, and pairs with as many are alike. The components of
alike classes are families; inside each the pairs are confirmed on full sets, again by counting over
inverted lists. Long lists and large families are compared in pairs of blocks, so no task gets a
whole one, and each comparison returns a forest of its links, so rows stay in proportion to classes
while no link between components is lost.

Null or blank text has an empty set, linked with nothing. Each row follows its own text; a row
without an id has no component and is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, mapped, read, shuffled, stored, to_batch
from .components import components

WIDTH, PERCENT = 5, 85
COORDINATES, CHANCE, LIST_BLOCK, SET_BLOCK = 32, 1.1e-8, 1_024, 512
#: Most ids that are sent to every executor; more are joined by a shuffle.
IDS_SENT = 1_000_000
_ODD = np.random.default_rng(20_240_501).integers(0, 2**63, (2, COORDINATES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Words(dict):
    """64-bit hashes of words; emptied when it holds 150,000."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hash = _Words()


def matches(percent: int) -> int:
    """Most coordinates in which sets of this similarity agree but for a chance of CHANCE at most."""
    p, missed, n = percent / 100, 0.0, 0
    while n < COORDINATES:
        missed += math.comb(COORDINATES, n) * p**n * (1 - p) ** (COORDINATES - n)
        if missed > CHANCE:
            break
        n += 1
    return max(n, 1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_hash[w] for w in words], np.uint64)
    width = min(width, len(h))
    n = len(h) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mixed(total + h[i : i + n])
    return np.unique(total)


def signature(found: np.ndarray) -> np.ndarray:
    """The upper halves of each coordinate's minimum."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max)
    for i in range(0, len(found), 8_192):
        least = np.minimum(least, (found[i : i + 8_192, None] * _ODD[0] + _ODD[1]).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig): set_key is a 128-bit digest of the set."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            known: dict[str | None, tuple] = {}
            for t in texts:
                if t not in known:
                    found = shingles(t)
                    known[t] = (len(found), xxhash.xxh128_digest(found.tobytes()), signature(found)) if len(found) else (0, None, None)
            yield to_batch(schema, [ids, *[[known[t][i] for t in texts] for i in range(3)]])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, set_key binary, sig array<int>")


def postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(coordinate, value, rep, n): each class under its rarest shared coordinate values."""
    each = classes.select("rep", "n", F.posexplode("sig").alias("coordinate", "value"))
    shared = each.groupBy("coordinate", "value").agg(F.count("*").alias("df")).filter("df > 1")
    held = each.join(shuffled(shared), ["coordinate", "value"]).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("df", "coordinate", "value"))).alias("held"))
    least = matches(percent)
    prefix = F.slice("held", 1, F.size("held") - least + 1)
    return held.filter(F.size("held") >= least).select("rep", "n", F.explode(prefix).alias("p")).select("p.coordinate", "p.value", "rep", "n")


def in_blocks(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """Rows of each group dealt to the cells of its pairs of blocks: cell, left and right (the sides a row is on).

    A group of n rows has ceil(n / size) blocks, so a cell holds about two blocks at most, whatever n.
    """
    sizes = rows.groupBy(*group).agg(F.count("*").alias("__n")).filter("__n > 1")
    blocks = F.ceil(F.col("__n") / size).cast("int")
    dealt = rows.join(shuffled(sizes.select(*group, blocks.alias("__blocks"))), group).withColumn("__mine", F.pmod(F.xxhash64("rep"), F.col("__blocks")).cast("int"))
    cells = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    cell = F.xxhash64(*group, F.least("__mine", "__other"), F.greatest("__mine", "__other"))
    return cells.withColumn("cell", cell).withColumn("left", F.col("__mine") <= F.col("__other")).withColumn("right", F.col("__mine") >= F.col("__other"))


def forest(n: int, u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """(root, node) for every node of a graph of n nodes with edges u - v but the roots: its components in few edges."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(u.tolist(), v.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def _edges(compare, percent: int):
    """Links of each cell as the edges of a forest; compare(cell, rows on the left, rows on the right, percent) yields index pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for cell in sorted_groups(batches, "cell"):
            if cell.num_rows < 2:
                continue
            left, right, rep = (cell.column(c).to_numpy() for c in ("left", "right", "rep"))
            found = [f for f in compare(cell, np.flatnonzero(left), np.flatnonzero(right), percent) if len(f[0])]
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                out += [(int(rep[x]), int(rep[y])) for x, y in forest(len(rep), u, v)]
        a, b = zip(*out) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _fits(n: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n[x][:, None], n[y][None]) >= percent * np.maximum(n[x][:, None], n[y][None])


def _by_signature(cell: pa.Table, left: np.ndarray, right: np.ndarray, percent: int):
    least, n = matches(percent), cell.column("n").to_numpy()
    sig = cell.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
    if len(n) == 2:
        if 100 * n.min() >= percent * n.max() and (sig[0] == sig[1]).sum() >= least:
            yield np.array([0]), np.array([1])
        return
    for i in range(0, len(left), 64):
        x = left[i : i + 64]
        counts = np.zeros((len(x), len(right)), np.int16)
        for k in range(COORDINATES):
            counts += sig[x, k][:, None] == sig[right, k][None]
        p, q = np.nonzero((counts >= least) & _fits(n, x, right, percent))
        yield x[p], right[q]


def _by_sets(cell: pa.Table, left: np.ndarray, right: np.ndarray, percent: int):
    """Full sets: an inverted list of the right side's shingles counts what each set of the left shares with all of them."""
    sets = [np.frombuffer(h.as_buffer(), np.uint64) for h in cell.column("hashes")]
    n = np.array([len(s) for s in sets])
    held = np.concatenate([sets[y] for y in right])
    owner = np.repeat(np.arange(len(right)), n[right])
    order = np.argsort(held, kind="stable")
    held, owner = held[order], owner[order]
    for x in left:
        low, high = np.searchsorted(held, sets[x], "left"), np.searchsorted(held, sets[x], "right")
        sizes = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())
        common = np.bincount(owner[at], minlength=len(right))
        q = np.flatnonzero(100 * common >= percent * (n[x] + n[right] - common))
        yield np.full(len(q), x), right[q]


def alike(posted: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs that agree in matches(percent) coordinates."""
    cells = in_blocks(posted, ["coordinate", "value"], LIST_BLOCK).select("cell", "left", "right", "rep", "n")
    signed = cells.join(shuffled(classes.select("rep", "sig")), "rep").select("cell", "left", "right", "rep", "n", "sig")
    return mapped(signed.repartition("cell").sortWithinPartitions("cell"), _edges(_by_signature, percent), "a long, b long").distinct()


def linked(families: DataFrame, docs: DataFrame, members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs in one family (rep, family) with full sets as similar as asked."""
    families = stored(families)
    sent = F.broadcast if families.count() <= IDS_SENT else shuffled
    schema = pa.schema([("rep", pa.int64()), ("set_key", pa.binary()), ("hashes", pa.binary())])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            found = [shingles(t).tobytes() for t in texts]
            yield to_batch(schema, [ids, [xxhash.xxh128_digest(f) for f in found], found])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(sent(families.select("rep")), "rep", "left_semi")
    held = mapped(texts, sets, "rep long, set_key binary, hashes binary")
    held = held.join(sent(members.join(sent(families), "rep", "left_semi")), ["rep", "set_key"], "left_semi").dropDuplicates(["rep"])
    rows = in_blocks(families, ["family"], SET_BLOCK).select("cell", "left", "right", "rep").join(shuffled(held.select("rep", "hashes")), "rep")
    return mapped(rows.select("cell", "left", "right", "rep", "hashes").repartition("cell").sortWithinPartitions("cell"), _edges(_by_sets, percent), "a long, b long")


def sorted_groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[pa.Table]:
    """Tables of the rows of each key (non-null integers), from batches sorted by it."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        keys = [table.column(k).to_numpy() for k in key]
        cuts = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])) if table.num_rows else []
        for begin, end in zip(cuts[:-1], cuts[1:]):
            yield table.slice(begin, end - begin)
        held = table.slice(cuts[-1]) if len(cuts) else None
    if held is not None and held.num_rows:
        yield held


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, set_key, component_id, kept. Sets of at least
    `percent` Jaccard similarity are linked."""
    signed = stored(signatures(docs))
    worded = signed.filter("n_shingles > 0 and doc_id is not null")
    first = worded.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = stored(first)
    members = classes.select("rep", "set_key")
    posted = stored(postings(classes, percent))
    near = components(alike(posted, classes, percent))
    roots = near.select(F.col("id").alias("rep"), F.col("root").alias("family"))
    families = roots.unionByName(near.select(F.col("root").alias("rep"), F.col("root").alias("family")).distinct())
    roots = components(linked(families, docs, members, percent))
    component = members.join(shuffled(roots.withColumnRenamed("id", "rep")), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component"))
    out = signed.join(shuffled(component), "set_key", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "set_key", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), PERCENT).drop("set_key")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the rows that repeat another: of each component the least id stays, and of rows equal in id
    and text one. An id stays if any of its rows is kept; a row without an id stays."""
    judged = stored(near_duplicates(docs.select("doc_id", "text"), percent))
    ids = judged.filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = stored(ids.filter("not kept").select("doc_id"))
    left = docs.join(F.broadcast(gone) if gone.count() <= IDS_SENT else shuffled(gone), "doc_id", "left_anti").select(docs.columns)
    if ids.filter("kept and n > 1").limit(1).count():
        one = Window.partitionBy("doc_id", F.xxhash64("text"), "text").orderBy(F.lit(0))
        again = left.filter("doc_id is not null").withColumn("__n", F.row_number().over(one)).filter("__n = 1").drop("__n")
        left = again.unionByName(left.filter("doc_id is null"))
    return left
