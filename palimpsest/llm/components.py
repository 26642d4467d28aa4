"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Nodes with more neighbours than this, and than a HUBS-th of the edges, are joined by broadcast, so that no task gets a
#: whole hub; there are at most 2 * HUBS of them.
HUB, HUBS = 1_000, 100_000


def with_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows (u, v) with m of least (u, m, n), the least neighbour of u; n is the number of neighbours."""
    hubs = F.broadcast(least.filter(F.col("n") > hub).select("u", "m"))
    others = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("n") <= hub).select("u", "m"), "u")
    return rows.join(hubs, "u").unionByName(others)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of edges (a, b) but the roots themselves; a root is its component's least id.

    Each step joins neighbours with their least neighbour, an aggregate that combines before the
    shuffle, and stores the new edges; only a count and a checksum come to the driver.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stored(e), None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before, hub = now, max(HUB, now[0] // HUBS)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = with_least(both, least, hub).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_least(large, least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = stored(small.filter("u <> v").distinct())
