"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free, join_hot

#: A node of more edges is a hub: they are dealt over tasks, so many to each.
HUB = 2000


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (two columns of longs); root: the smallest node of its component.

    Each step sends a node's larger neighbours to the smallest one, so the edges never grow in number; it ends when every component is a star around its smallest node. The edges of a hub are dealt by a hash of their other end, and its smallest neighbour is repeated for each deal.
    """
    a, b = edges.columns
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # in one pass: ends that no star has (a larger end has one edge and is no smaller end), and hubs
        ends = both.groupBy("u").agg(F.count_if(F.col("u") > F.col("v")).alias("up"), F.count_if(F.col("u") < F.col("v")).alias("down"))
        bad, hubs = ends.agg(F.count_if(F.expr("up > 1 or (up = 1 and down > 0)")), F.count_if(F.col("up") + F.col("down") > HUB)).first()
        if not bad:
            break
        deals = cut(ends.where(F.col("up") + F.col("down") > HUB).select("u", ((F.col("up") + F.col("down")) / HUB).cast("int").alias("deals"))) if hubs else None
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _by_u(both, least, deals, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node has no more edges here than before, so the same nodes may be hubs
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _by_u(large, low, deals, hubs).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        last, now = now, cut(small)
        free(last)
        if deals is not None:
            free(deals)
    out = cut(now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    free(now)
    return out


def _by_u(edges: DataFrame, least: DataFrame, deals: DataFrame | None, hubs: int) -> DataFrame:
    """`edges` (u, v) with the `m` of their u."""
    if deals is None:
        return edges.join(least, "u")
    deals = F.broadcast(deals) if hubs <= 250_000 else deals  # 12 bytes each
    n = F.coalesce("deals", F.lit(0))
    dealt = edges.join(deals, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), n + 1).cast("int").alias("deal"))
    wide = least.join(deals, "u", "left").select("u", "m", F.explode(F.sequence(F.lit(0), n)).alias("deal"))
    return dealt.join(wide, ["u", "deal"]).select("u", "v", "m")


def named(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, component_id) of `nodes` (node, id), one row a node; component_id: the smallest id in the node's component, by `roots` (node, root); nodes that it lacks are alone."""
    known = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    ids = known.groupBy("root").agg(F.min("id").alias("component_id"))
    return join_hot(known.select("node", "root"), ids, "root").select("node", "component_id")
