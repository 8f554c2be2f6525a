"""Iterative graph analytics over a relation ``G(src, dst)``.

Values travel against the direction of the edges: what is known of ``dst`` is summed up for ``src``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.iterate import MAX_ROUNDS, assign_rounds, fixpoint
from weftline.operators.relational import natural_join
from weftline.plans.materialize import stored


def pagerank_step(weights: DataFrame, degree: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, weight)``: 0.85 times the sum of weight times degree over the edges to ``dst``, plus 0.15."""
    shares = natural_join(weights, degree).select("dst", (F.col("weight") * F.col("degree")).alias("share"))
    sums = natural_join(shares, edges).groupBy("src").agg(F.sum("share").alias("s"))
    return sums.select("src", (F.lit(0.85) * F.col("s") + F.lit(0.15)).alias("weight"))


def pagerank(edges: DataFrame, degree: DataFrame, weights: DataFrame, rounds: int = MAX_ROUNDS) -> DataFrame:
    """Weights ``(dst, weight)`` after ``rounds`` steps.  Nodes without an edge out drop out, as each result replaces the last."""
    return assign_rounds(weights, lambda w: pagerank_step(w, degree, edges).withColumnRenamed("src", "dst"), rounds)


def two_hop_pagerank(edges: DataFrame, rounds: int = MAX_ROUNDS, distinct: bool = False) -> DataFrame:
    """:func:`pagerank` over :func:`two_hop`, all weights 1 and degrees 1 / (edges in) at first, without building that graph.

    A sum over paths of two edges is a sum over edges of sums over edges.  With ``distinct``, pairs of ends with more paths than one
    are found once, and what their other paths add is taken off.
    """
    count = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("dst", "src")
    into = natural_join(edges, count).groupBy("dst").agg(F.sum("n").alias("n"))
    more = None
    if distinct:
        paths = two_hop(edges).repartition("src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        more = stored(paths.where("n > 1").select("src", "dst", (F.col("n") - 1).alias("more")))
        into = into.unionAll(more.groupBy("dst").agg((-F.sum("more")).alias("n"))).groupBy("dst").agg(F.sum("n").alias("n"))
    degree = stored(into.select("dst", (F.lit(1.0) / F.col("n")).alias("degree")))

    def step(weights: DataFrame) -> DataFrame:
        shares = natural_join(weights, degree).select("dst", (F.col("weight") * F.col("degree")).alias("share"))
        near = natural_join(shares, edges).groupBy("src").agg(F.sum("share").alias("share")).withColumnRenamed("src", "dst")
        parts = natural_join(near, edges).groupBy("src").agg(F.sum("share").alias("s"))
        if more is not None:
            extra = natural_join(shares, more).select("src", (-F.col("share") * F.col("more")).alias("s"))
            parts = parts.unionAll(extra).groupBy("src").agg(F.sum("s").alias("s"))
        return parts.select(F.col("src").alias("dst"), (F.lit(0.85) * F.col("s") + F.lit(0.15)).alias("weight"))

    return assign_rounds(degree.select("dst", F.lit(1.0).alias("weight")), step, rounds)


def min_label_step(delta: DataFrame, edges: DataFrame) -> DataFrame:
    return natural_join(delta, edges).groupBy("src").agg(F.min("weight").alias("weight"))


def components(edges: DataFrame, max_rounds: int = MAX_ROUNDS, hops: int = 1) -> DataFrame:
    """``(src, weight)``: the smallest node with an edge out that each node can reach in one step or more.

    A step is a path of ``hops`` edges.  Such paths aren't built: the least value of their ends is found edge by edge.
    """
    sources = edges.select(F.col("src").alias("dst")).distinct()
    for _ in range(hops - 1):
        sources = natural_join(edges, sources).select(F.col("src").alias("dst")).distinct()
    start = sources.withColumn("weight", F.col("dst"))
    empty = start.select(F.col("dst").alias("src"), "weight").where("false")

    def step(delta: DataFrame) -> DataFrame:
        for _ in range(hops):
            delta = min_label_step(delta.toDF("dst", "weight"), edges)
        return delta

    return fixpoint(empty, start, step, ["src"], "weight", "min", max_rounds)


def hop_step(delta: DataFrame, edges: DataFrame) -> DataFrame:
    return natural_join(delta, edges).groupBy("src").agg(F.min(F.col("weight") + 1).alias("weight"))


def shortest_hops(edges: DataFrame, landmark: int, max_rounds: int = MAX_ROUNDS, hops: int = 1) -> DataFrame:
    """``(src, weight)``: steps on the shortest way of one step or more from each node to ``landmark``; a step is a path of ``hops`` edges."""
    start = edges.sparkSession.createDataFrame([(landmark, 0)], "dst long, weight long")
    empty = start.toDF("src", "weight").where("false")

    def step(delta: DataFrame) -> DataFrame:
        for _ in range(hops - 1):
            delta = min_label_step(delta.toDF("dst", "weight"), edges)
        return hop_step(delta.toDF("dst", "weight"), edges)

    return fixpoint(empty, start, step, ["src"], "weight", "min", max_rounds)


def two_hop(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """The graph of paths of two edges, as a bag or once for each pair of ends."""
    first, second = edges.toDF("src", "mid"), edges.toDF("mid", "dst")
    pairs = natural_join(first, second).select("src", "dst")
    return pairs.distinct() if distinct else pairs
