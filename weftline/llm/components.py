"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, dropped, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges(u, v)`` with the smallest node it can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step
    keeps at most one row for an edge, and the number of rounds grows with the
    logarithm of the longest path.  The minima are checkpointed before the join that
    uses them, so a hub's edges meet in an ordinary shuffle join, which adaptive
    execution can split; nothing is sent through the driver.  Each round's edges are written as a table: a checkpoint would
    carry the planner's constraints on into the next round, where they multiply.  Self-loops and null ends are dropped; returns
    ``(node, root)`` for nodes with at least one edge to another node.
    """
    directed = edges.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    current = stored(directed.distinct())
    state = _state(current)
    for _ in range(max_rounds):
        if not state[0]:
            break
        old, current = current, stored(_small_star(_large_star(current)))
        dropped(old)
        new = _state(current)
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.bit_xor(F.xxhash64("v", "u")).alias("y"),
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(checkpointed(least).hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node, to the smallest of them."""
    edges = checkpointed(edges)
    least = checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")))
    moved = edges.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
