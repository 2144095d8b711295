"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import cut
from .skew import join_hot


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
    return row["n"], row["sum"]


def star_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that they connect it to.

    Every round hangs each node's larger neighbours on its smallest one, and then its smaller
    neighbours likewise, until nothing changes; rounds grow with the logarithm of the longest path.
    Minima are taken before rows move, and hubs are joined where their edges lie. Null ends and loops are left out.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    tree = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = _state(tree)
    while state[0]:
        both = tree.unionByName(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k")).select("a", F.least("a", "m").alias("m"), "k")
        up = join_hot(both.where("b > a"), least, ["a"], "k", 2 * state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        up = cut(up.distinct())
        least = up.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("k"))
        down = join_hot(up, least, ["a"], "k", 2 * state[0]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        tree = cut(down.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = _state(tree)
        if now == state:
            break
        state = now
    return tree.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        tree.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def connected_components(nodes: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """(node, root): every node with the smallest node that edges (a, b) connect it to; lone nodes are their own root."""
    found = star_components(edges).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return nodes.select(node).join(found, F.col(node) == F.col("_n"), "left").select(node, F.coalesce("_r", node).alias("root"))
