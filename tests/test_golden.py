"""Natural joins, aggregates and graph steps with known results; join columns as sets of rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import analytics as A
from weftline.operators import relational as R
from weftline.plans import multiway
from weftline.plans.hypercube import hypercube_join

# Input relations.
A1, A2 = [(0, 1), (1, 2), (2, 3)], [(1, 2), (2, 3), (3, 4)]
X1, X2 = [(0, 0), (1, 1), (1, 2), (4, 3), (2, 4)], [(0, 0), (1, 1), (2, 3), (3, 2), (4, 3)]
X3, T3 = [(0, 0), (1, 1), (3, 4), (2, 1), (3, 1)], [(0, 0), (1, 1), (1, 3), (4, 2), (2, 3)]
C4, D4 = [(0, 0), (1, 1), (4, 1), (1, 4), (1, 2)], [(0, 1), (1, 2), (4, 3), (1, 4), (1, 5)]
E5, F6 = [(0, 1), (1, 2), (1, 3), (4, 4), (2, 5)], [(0, 1), (1, 2), (3, 3), (2, 4), (3, 5)]
H7 = [(0, 0), (1, 1), (1, 4), (4, 1), (2, 1)]
G = [(0, 1), (1, 2), (1, 3), (1, 4), (2, 3)]

# Inputs by columns, and the rows of their natural join.
JOINS = {
    "acyclic": ([("ab", A1), ("bc", A2)], {(0, 1, 2), (1, 2, 3), (2, 3, 4)}),
    "triangle": ([("ab", X1), ("bc", X2), ("ac", T3)], {(0, 0, 0), (1, 1, 1), (1, 2, 3), (4, 3, 2), (2, 4, 3)}),
    "square": (
        [("ab", X1), ("bc", X2), ("cd", X3), ("da", C4)],
        {(0, 0, 0, 0), (1, 1, 1, 1), (1, 2, 3, 4), (4, 3, 2, 1), (2, 4, 3, 1), (1, 2, 3, 1)},
    ),
    "seven relations": (
        [("ab", X1), ("bc", X2), ("cd", X3), ("de", D4), ("ae", E5), ("ac", T3), ("ad", H7)],
        {(0, 0, 0, 0, 1), (1, 1, 1, 1, 2), (1, 2, 3, 4, 3), (4, 3, 2, 1, 4), (2, 4, 3, 1, 5), (1, 2, 3, 1, 2)},
    ),
    "house": (
        [("ab", X1), ("bc", X2), ("cd", X3), ("de", D4), ("ae", E5), ("ce", F6)],
        {(0, 0, 0, 0, 1), (1, 1, 1, 1, 2), (1, 2, 3, 4, 3), (4, 3, 2, 1, 4), (2, 4, 3, 1, 5)},
    ),
    "with a key": ([("ab", A1), ("bc", A2), ("cd", [(2, 2), (3, 3), (4, 4)])], {(0, 1, 2, 2), (1, 2, 3, 3), (2, 3, 4, 4)}),
    "square with a key": (
        [("ab", X1), ("bc", X2), ("cd", X3), ("da", C4), ("de", [(0, 0), (1, 1), (4, 4)])],
        {(0, 0, 0, 0, 0), (1, 1, 1, 1, 1), (1, 2, 3, 4, 4), (4, 3, 2, 1, 1), (2, 4, 3, 1, 1), (1, 2, 3, 1, 1)},
    ),
}


@pytest.fixture(scope="module")
def relation(spark):
    def make(columns: str, rows):
        return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))

    return make


def rows_of(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("name", JOINS)
@pytest.mark.parametrize("way", ["tree", "planned", "hypercube"])
def test_joins(relation, name, way):
    inputs, want = JOINS[name]
    parts = [relation(*i) for i in inputs]
    order = sorted({c for columns, _ in inputs for c in columns})
    if way == "tree":
        got = R.natural_join_all(parts).select(*order)
    elif way == "planned":
        got = multiway.joined(parts, order)
    else:
        got = hypercube_join(parts, tasks=4, order=order)
    found = got.collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_counts(relation):
    assert rows_of(multiway.count_by([relation("ab", A1), relation("bc", A2)], ["b"])) == {(1, 1), (2, 1), (3, 1)}
    house = [relation(*i) for i in JOINS["house"][0]]
    assert rows_of(multiway.count_by(house, ["a"])) == {(0, 1), (1, 2), (4, 1), (2, 1)}


def test_distinct_projections_then_aggregates(relation):
    square = [relation(*i) for i in JOINS["square"][0]]
    assert rows_of(multiway.distinct_pairs_then_count(square, ["a", "c"], "a")) == {(0, 1), (1, 2), (4, 1), (2, 1)}
    second = [*square, relation("ac", T3)]
    assert rows_of(multiway.distinct_pairs_then_count(second, ["b", "d"], "b")) == {(0, 1), (1, 1), (2, 2), (3, 1), (4, 1)}
    third = [relation("ab", X1), relation("bc", X2), relation("ac", T3), relation("cd", [(i, i) for i in range(4)])]
    assert rows_of(multiway.distinct_pairs_then_count(third, ["b", "c"], "b")) == {(i, 1) for i in range(5)}
    r1, r2 = relation("ab", [(0, 1), (1, 2), (1, 3), (1, 4), (2, 3)]), relation("bc", [(1, 2), (2, 3), (3, 3), (4, 4), (3, 4)])
    pairs = R.project(R.natural_join(r1, r2), "a, c")
    sums = R.aggregate(R.natural_join(pairs, relation("cw", [(2, 2), (3, 3), (4, 4)])), "sum(w) as s", "a")
    assert rows_of(sums) == {(0, 2), (1, 7), (2, 7)}


@pytest.fixture(scope="module")
def graph(spark):
    edges = spark.createDataFrame(G, "src long, dst long")
    degree = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 0.5), (4, 1.0)], "dst long, degree double")
    return edges, degree, lambda rows: spark.createDataFrame(rows, "dst long, weight double")


def close(df) -> dict:
    return {r[0]: pytest.approx(r[1], abs=1e-9) for r in df.collect()}


def test_pagerank_step(graph):
    edges, degree, weights = graph
    assert close(A.pagerank_step(weights([(i, 1.0) for i in range(1, 5)]), degree, edges)) == {0: 1.0, 1: 2.275, 2: 0.575}


@pytest.mark.parametrize("distinct", [False, True])
def test_two_hop_pagerank_step(graph, distinct):
    edges, degree, weights = graph
    two = A.two_hop(edges, distinct)
    assert close(A.pagerank_step(weights([(i, 1.0) for i in range(1, 5)]), degree, two)) == {0: 2.275, 1: 0.575}


@pytest.mark.parametrize("distinct", [False, True])
def test_two_hop_pagerank_by_edges(spark, distinct):
    """Node 0 reaches 3, 4 and 5 over two nodes each; sums over edges less the second paths equal those over the pairs."""
    edges = spark.createDataFrame([(0, 1), (0, 2), *[(m, d) for m in (1, 2) for d in (3, 4, 5)], (3, 0), (4, 0), (5, 1), (6, 0)], "src long, dst long")
    two = A.two_hop(edges, distinct)
    degree = two.groupBy("dst").agg((F.lit(1.0) / F.count(F.lit(1))).alias("degree"))
    want = close(A.pagerank(two, degree, degree.select("dst", F.lit(1.0).alias("weight")), 3))
    assert close(A.two_hop_pagerank(edges, 3, distinct)) == want and want


def test_component_and_hop_steps(graph):
    edges, _, weights = graph
    assert close(A.min_label_step(weights([(i, float(i)) for i in range(1, 5)]), edges)) == {0: 1, 1: 2, 2: 3}
    assert close(A.hop_step(weights([(1, 0.0)]), edges)) == {0: 1}


def test_fixpoints(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6)], "src long, dst long")
    assert rows_of(A.components(edges)) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert rows_of(A.shortest_hops(edges, 1)) == {(3, 1), (2, 2), (4, 2), (1, 3)}
    assert rows_of(A.shortest_hops(edges, 1, max_rounds=1)) == {(3, 1)}
    assert edges.where(F.col("src") > 99).count() == 0
