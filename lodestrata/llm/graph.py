"""Connected components of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that edges(u, v) lead to, for each node that is not that smallest itself.

    Each step keeps what is connected and brings nodes nearer to their smallest; it ends when nothing changes, after a
    number of steps that grows with the logarithm of the size. Edges are written to the shared folder after each step, and those
    of the step before are deleted; only counts and sums reach the driver. Minima are taken before the shuffle, so a node with very
    many edges is no hot key there; the join with them is one that Spark can split."""
    edges = cut(edges.filter("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    last = None
    while True:
        seen = Observation()
        total = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)"))
        new = cut(_small_star(_large_star(edges)), "edges", seen, n=F.count(F.lit(1)), s=total)
        release(edges)
        edges, now = new, seen.get
        if now == last or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        last = now


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels(node, component), as components() gives them, after more edges(u, v): these are contracted to components first, so what is
    walked again is as small as they are. Without edges, labels as they are."""
    end = lambda x: labels.select(F.col("node").alias(x), F.col("component").alias(f"{x}_c"))
    some = edges.join(end("u"), "u", "left").join(end("v"), "v", "left").select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v"))
    some = cut(some.filter("u <> v").distinct(), "contracted")
    if some.isEmpty():
        release(some)
        return labels
    more = components(some)
    release(some)
    moved = labels.join(more.toDF("component", "_to"), "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
    return cut(moved.unionByName(more), "labels")
