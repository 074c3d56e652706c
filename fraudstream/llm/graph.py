"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the component's smallest node.

    In a round each node points its larger, then its smaller neighbours at the smallest
    one; the number of edges doesn't grow, and rounds grow with the logarithm of the
    nodes. Smallest neighbours are partial aggregates and the joins are plain equality
    joins, so a node with very many neighbours is split like any skewed join key. Each
    round is a written table: nothing is collected, and lineage stays short.
    """
    u, v = F.col("u"), F.col("v")
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "graph",
    )
    seen = _digest(now)
    while seen[0]:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.*").filter("u <> v").distinct()
        now = materialize(small, "graph")
        found = _digest(now)
        if found == seen:
            break
        seen = found
    roots = now.select(v.alias("node"), v.alias("root")).distinct()
    return now.select(u.alias("node"), v.alias("root")).unionByName(roots)
