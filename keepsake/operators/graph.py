"""Connected components over an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.runtime import cut


def _print(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges that does not depend on their order."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node.

    Alternates the large-star and small-star steps: each rewires the edges of
    a node towards the smallest node of its neighbourhood, so a component
    becomes a star around its smallest node in O(log^2 n) rounds, and no node
    ever gathers its neighbours in one row: minima are aggregated with map-side
    combine and joined back. Every round is written to the shared checkpoint
    folder, and the rounds end when the edges stay as they are. Edges with a
    null end and self-loops carry no link and are dropped; an empty edge table
    gives an empty result.
    """
    e = cut(
        edges.select(F.col(src).alias("u"), F.col(dst).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _print(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u hangs on the minimum around u.
        large = both.where("v > u").hint("merge").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u and its smaller neighbours hang on the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.hint("merge").join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").distinct())
        now = _print(e)
        if now == before:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
