"""Connected components over edges of long node ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import materialised


def _star_edges(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (big, small) edges."""
    both = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(edges.select(F.col("small").alias("u"), F.col("big").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("big"), F.col("m").alias("small")).distinct()
    lowest = large.groupBy("big").agg(F.min("small").alias("m"))
    moved = large.join(lowest, "big").where("small <> m").select(F.col("small").alias("big"), F.col("m").alias("small"))
    return moved.unionByName(lowest.select("big", F.col("m").alias("small"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("big", "small"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of an edge between different nodes; root is the least node it can reach.

    Null ends and loops are ignored; repeated edges count once; no edge gives no row. Every round is
    written to the shared folder, and only a count and a checksum of the edges reach the driver. A node
    with many neighbours is one group of a minimum, which is formed before the shuffle, and one key of
    a join, which adaptive execution splits.
    """
    ends = edges.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialised(ends.distinct())
    seen = _signature(now)
    while seen[0]:
        now = materialised(_star_edges(now))
        before, seen = seen, _signature(now)
        if before == seen:
            break
    return now.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(now.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct())
