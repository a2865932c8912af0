"""Connected components over edge tables, by alternating large and small stars.

Every round points each node at the smallest node that it or a neighbour knows; a path of n nodes takes about
log n rounds.  Rounds are group-bys and joins on the node and are cut with checkpoints.  A node with very many
neighbours is pre-aggregated for its minimum, and salted in the join that hands the minimum back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import durable, hot_keys, salted_join

#: Below so many edges no node can have neighbours enough to need salt.
SALT_FROM = 1_000_000


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _with_least(edges: DataFrame, n_edges: int, salt_from: int) -> DataFrame:
    """`edges` with m, the smallest v of their u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    if n_edges < salt_from:
        return edges.join(least.drop("degree"), "u")
    return salted_join(edges, least.drop("degree"), ["u"], hot_keys(least, ["u"], "degree", total=n_edges), "v")


def _large_star(edges: DataFrame, n_edges: int, salt_from: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select("v", "u"))
    known = _with_least(both, 2 * n_edges, salt_from).where("v > u")
    return known.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n_edges: int, salt_from: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    moved = _with_least(down, n_edges, salt_from).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(down.groupBy("u").agg(F.min("v").alias("v")).select("u", "v")).distinct()


def components(edges: DataFrame, salt_from: int = SALT_FROM) -> DataFrame:
    """(node, root) for each node that has an edge in `edges` (u, v long); root is the smallest node it reaches.

    Loops and repeated edges are ignored; an empty table gives an empty result.
    """
    now = durable(edges.select("u", "v").where("u <> v").distinct())
    seen = _signature(now)
    while seen[0]:
        after = durable(_small_star(_large_star(now, seen[0], salt_from), seen[0], salt_from))
        signature = _signature(after)
        now, unchanged = after, signature == seen
        seen = signature
        if unchanged:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
