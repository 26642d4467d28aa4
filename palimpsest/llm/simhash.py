"""SimHash near-duplicates by a hierarchical index in Gray order.

A text's words (lower-cased ASCII, between ASCII white space) give three-word shingles, repeats included; fewer words are
one shingle. A fingerprint bit is 1 if more than half of the shingles' XXH64 values have it. Texts without words, and
nulls, have fingerprint zero, which is linked like any other.

Fingerprints of at most `distance` differing bits agree in one of distance + 1 blocks of bits at least. For each block,
distinct fingerprints are turned so that it leads and sorted by Gray rank, where neighbours share most of their bits; the pattern of
the leading block is a top node, and what lies below it is cut into leaves of LEAF, numbered in order. A node keeps the
bits that all that lies below it has and those that some has: where the two are equal, its pattern is fixed. Runs of FAN nodes
have a parent. Below each top node, pairs of nodes go down the tree together: the number of bits that are fixed in both and
differ is a lower bound of every difference below, so a pair over `distance` is pruned with all that it holds. Pairs of
leaves that are left are compared in full.

Before that, fingerprints are linked within leaves, in a linear pass, and their components are taken. A node that lies in one component
carries it, and nodes of the same one need not meet: a family of near copies, however large, is not compared in all its
pairs. Each comparison returns a forest of its links, so no link between components is lost.

Every row follows its own text. A row without an id has a fingerprint and no component. Repeated rows and equal texts share
a component. Only doc_id and text are read, so further columns may have any names; texts are read whole, of any length. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_batches, mapped, read, stored, to_batch
from .components import components
from .near_dups import forest

WIDTH, SEED, DISTANCE = 3, 42, 3
#: Fingerprints of a leaf, children of a node, and shingles whose bits are counted at once.
LEAF, FAN, AT_ONCE = 64, 16, 16_384
_LANES = 8 * np.arange(8, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    width = min(WIDTH, len(words))
    joined = b" ".join(words)
    begins = np.cumsum([0, *(len(w) + 1 for w in words)])
    spans = zip(begins[: len(words) - width + 1].tolist(), (begins[width:] - 1).tolist())
    hashed = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashed), AT_ONCE):
        counts += bits_set(hashed[i : i + AT_ONCE])
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashed)).astype(np.uint64)).sum(dtype=np.uint64))


def bits_set(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit, from the lowest: at most 255 values are added in the bytes of one word."""
    counts = np.zeros(64, np.int64)
    lanes = np.uint64(0x0101010101010101)
    starts = np.arange(0, len(values), 255)
    for bit in range(8):
        sums = np.add.reduceat((values >> np.uint64(bit)) & lanes, starts)
        counts[bit::8] = ((sums[:, None] >> _LANES) & np.uint64(255)).sum(axis=0)
    return counts


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): each row's fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_batches(2, 1, batches):
            known = {t: fingerprint(t) for t in set(texts)}
            yield to_batch(schema, [ids, np.array([known[t] for t in texts], np.uint64).view(np.int64)])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, bits long")


def gray_rank(bits: Column) -> Column:
    """Place of the bits in Gray order, as a long that sorts like the unsigned number."""
    rank = bits
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def leaves(classes: DataFrame, block: int, distance: int) -> DataFrame:
    """(space, prints): runs of at most LEAF distinct fingerprints in Gray order, turned so that one of the distance + 1
    blocks leads, of 8 bytes each. A space is a block and its pattern. Ranges of the order are dealt to tasks."""
    begin, end = 64 * block // (distance + 1), 64 * (block + 1) // (distance + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns])], axis=1)
            whole = np.flatnonzero(held[0] == held[0, -1])[0] if held.shape[1] else 0
            whole += (held.shape[1] - whole) // LEAF * LEAF
            yield _runs(held[:, :whole])
            held = held[:, whole:]
        yield _runs(held)

    bits = F.col("bits")
    turned = F.shiftleft(bits, begin).bitwiseOR(F.shiftrightunsigned(bits, 64 - begin)) if begin else bits
    top = F.shiftrightunsigned(turned, 64 - (end - begin)) if end - begin < 64 else F.lit(0)
    ranked = classes.select((F.lit(block).cast("long") + top * (distance + 1)).alias("space"), "bits", gray_rank(turned).alias("rank"))
    return mapped(ranked.repartitionByRange("rank").sortWithinPartitions("rank").select("space", "bits"), run, "space long, prints binary")


def _runs(held: np.ndarray) -> pa.RecordBatch:
    cuts = [0, *(np.flatnonzero(held[0, 1:] != held[0, :-1]) + 1).tolist(), held.shape[1]] if held.shape[1] else [0]
    spans = [(i, min(i + LEAF, end)) for begin, end in zip(cuts, cuts[1:]) for i in range(begin, end, LEAF)]
    return pa.RecordBatch.from_arrays([pa.array([int(held[0, i]) for i, _ in spans], pa.int64()), pa.array([held[1, i:j].tobytes() for i, j in spans], pa.binary())], ["space", "prints"])


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows stored with their numbers in order; what is added up in one task is one count for each task that wrote them."""
    placed = stored(rows.withColumn("__id", F.monotonically_increasing_id()))
    task, at = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit(2**33 - 1))
    counts = placed.groupBy(task.alias("__task")).agg((F.max(at) + 1).alias("n"))
    before = counts.select("__task", (F.sum("n").over(Window.orderBy("__task")) - F.col("n")).alias("__before"))
    return placed.withColumn("__task", task).join(F.broadcast(before), "__task").withColumn(name, F.col("__before") + at).drop("__id", "__task", "__before")


def as_prints(binary: pa.Scalar) -> np.ndarray:
    return np.frombuffer(binary.as_buffer(), np.uint64)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x).view(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _links(x: np.ndarray, y: np.ndarray | None, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Forest of the links between two leaves, or within one."""
    near = np.bitwise_count(x[:, None] ^ (x if y is None else y)[None]) <= distance
    u, v = np.nonzero(np.triu(near, 1) if y is None else near)
    if not len(u):
        return []
    both = x if y is None else np.concatenate([x, y])
    tree = np.array(forest(len(both), u, v if y is None else v + len(x)))
    return [(both[tree[:, 0]], both[tree[:, 1]])]


def linked_within(held: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of fingerprints of the same leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edges([f for prints in batch.column(0) for f in _links(as_prints(prints), None, distance)])

    return mapped(held.select("prints"), run, "a long, b long")


def linked_between(pairs: DataFrame, held: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) of fingerprints of the pairs (x, y) of leaves (leaf, prints)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edges([f for x, y in zip(batch.column(0), batch.column(1)) for f in _links(as_prints(x), as_prints(y), distance)])

    side = lambda name, prints: held.select(F.col("leaf").alias(name), F.col("prints").alias(prints))
    return mapped(pairs.join(side("x", "left"), "x").join(side("y", "right"), "y").select("left", "right"), run, "a long, b long")


def nodes(rows: DataFrame, key: Column) -> DataFrame:
    """(space, node, all, some, least, most) from rows with such columns below the node `key`; least and most are of the components."""
    parts = [F.bit_and("all").alias("all"), F.bit_or("some").alias("some"), F.min("least").alias("least"), F.max("most").alias("most")]
    return rows.groupBy("space", key.alias("node")).agg(*parts)


def leaf_nodes(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes of leaves (space, leaf, prints), given the components (id, root) of their fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_prints(p).view(np.int64) for p in batch.column(2)]
            space, leaf = (np.repeat(batch.column(i).to_numpy(), [len(p) for p in prints]) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(space, pa.int64()), pa.array(leaf, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *prints]))], ["space", "leaf", "id"])

    each = mapped(held.select("space", "leaf", "prints"), run, "space long, leaf long, id long").join(roots, "id", "left")
    root = F.coalesce("root", "id")
    return nodes(each.select("space", "leaf", F.col("id").alias("all"), F.col("id").alias("some"), root.alias("least"), root.alias("most")), F.col("leaf"))


def pruned(pairs: DataFrame, level: DataFrame, parent: Column, distance: int) -> DataFrame:
    """Pairs (space, x, y), x <= y, of the nodes of a level that lie below the pairs of their parents and may hold a link."""
    entry = F.struct("node", "all", "some", "least", "most")
    below = level.groupBy("space", parent.alias("parent")).agg(F.collect_list(entry).alias("nodes"))  # FAN nodes at most
    side = lambda name, nodes: below.select("space", F.col("parent").alias(name), F.col("nodes").alias(nodes))
    met = pairs.join(side("x", "left"), ["space", "x"]).join(side("y", "right"), ["space", "y"])
    met = met.select("space", F.explode("left").alias("l"), "right").select("space", "l", F.explode("right").alias("r"))
    free = F.expr("(l.all ^ l.some) | (r.all ^ r.some)")
    near = F.bit_count(F.expr("l.all ^ r.all").bitwiseAND(F.bitwise_not(free))) <= distance
    joined = F.expr("l.least = l.most AND r.least = r.most AND l.least = r.least")
    return met.filter(F.expr("l.node <= r.node") & near & ~joined).select("space", F.col("l.node").alias("x"), F.col("r.node").alias("y"))


def near_leaves(held: DataFrame, roots: DataFrame, distance: int) -> DataFrame:
    """Pairs (x, y), x < y, of leaves of one space that may hold a link between components (id, root)."""
    several = held.groupBy("space").agg(F.count("*").alias("n")).filter("n > 1").select("space")
    tree, parent = [stored(leaf_nodes(held.join(several, "space", "left_semi"), roots))], F.floor(F.col("node") / FAN)
    while (tree[-1].groupBy("space").count().agg(F.max("count")).first()[0] or 0) > FAN:
        tree.append(stored(nodes(tree[-1], parent)))
    zero = F.lit(0).cast("long")
    pairs = tree[-1].select("space", zero.alias("x"), zero.alias("y")).distinct()
    for i, level in enumerate(reversed(tree)):
        pairs = stored(pruned(pairs, level, parent if i else zero, distance))
    return pairs.filter("x < y")


def leaf_table(classes: DataFrame, distance: int) -> DataFrame:
    """(space, leaf, prints) of all blocks' orders."""
    found = [leaves(classes, block, distance) for block in range(distance + 1)]
    return stored(numbered(reduce(DataFrame.unionByName, found), "leaf"))


def near_fingerprints(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, root) of distinct fingerprints (bits), but of the roots: links are at most `distance` differing bits."""
    held = leaf_table(classes, distance)
    links = stored(linked_within(held, distance))
    between = linked_between(near_leaves(held, components(links), distance), held, distance)
    return components(links.unionByName(between))


def simhash_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id."""
    signed = stored(fingerprints(docs))
    classes = stored(signed.filter("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = near_fingerprints(classes, distance)
    placed = stored(classes.join(roots, classes["bits"] == roots["id"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root")))
    owners = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    out = signed.join(placed.join(owners, "root").select("bits", "component_id"), "bits", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), component.alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
