from __future__ import annotations

import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import pytest

from tests.conftest import ROOT
from weftline import catalogue

SF = os.environ.get("WEFTLINE_TEST_SF", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def norm(v) -> str:
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    run = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([norm(v) for _, v in sorted(zip(names, r, strict=True))] for r in run.fetchall())
    assert sorted([norm(r[c]) for c in sorted(names)] for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_pagerank_rounds_exact_weights(spark):
    """Weights at half a millionth, of which there are eight, go up whatever the order of the sums."""
    from weftline.queries import graphs

    pairs = [tuple(r) for r in graphs.edges(spark, "/root/testdata/sf0.01").collect()]
    degree = Counter(dst for _, dst in pairs)
    weights = dict.fromkeys(degree, Fraction(1))
    for _ in range(graphs.PAGERANK_ROUNDS):
        sums = defaultdict(Fraction)
        for src, dst in pairs:
            if dst in weights:
                sums[src] += weights[dst] / degree[dst]
        weights = {k: Fraction(85, 100) * s + Fraction(15, 100) for k, s in sums.items()}
    millionths = {k: w * 10**6 for k, w in weights.items()}
    assert sum(m % 1 == Fraction(1, 2) for m in millionths.values()) == 8
    got = {r.dst: r.weight for r in catalogue.QUERIES["analytic_I1_pagerank"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {k: int(m + Fraction(1, 2)) / 10**6 for k, m in millionths.items()}


def small_graph(folder, nodes: int, orders: list[tuple[int, int]]):
    """Tables of customers and of orders (key, customer) and a connection with views of them."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS c_custkey, (i % 25)::INT AS c_nationkey FROM range({nodes}) r(i)) TO '{folder}/customer.parquet' (FORMAT parquet)")
    rows = ", ".join(f"({k}::BIGINT, {c}::BIGINT)" for k, c in orders)
    con.execute(f"COPY (SELECT * FROM (VALUES {rows}) o(o_orderkey, o_custkey)) TO '{folder}/orders.parquet' (FORMAT parquet)")
    for name in ("customer", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def same_as_sql(spark, con, folder, name):
    df = catalogue.QUERIES[name](spark, str(folder))
    run = con.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in run.description]
    want = sorted(tuple(norm(v) for v in r) for r in run.fetchall())
    assert sorted(tuple(norm(r[c]) for c in names) for r in df.collect()) == want
    return want


def test_assigning_rounds_count_edges_to_nodes_without_an_edge_out(spark, tmp_path):
    con = small_graph(tmp_path, 10, [(k, k % 4) for k in range(24)])
    assert same_as_sql(spark, con, tmp_path, "iterate_assign")


@pytest.mark.parametrize("number", ["G1I1_pagerank", "G1I2_components", "G1I3_shortest_hops", "G2I1_pagerank", "G2I2_components", "G2I3_shortest_hops"])
def test_two_hop_analytics_without_the_two_hop_graph(spark, tmp_path, monkeypatch, number):
    """Pairs of ends with several paths, and nodes without an edge out; only the count of several paths may build the paths, once."""
    from weftline.operators import analytics

    con = small_graph(tmp_path, 12, [(k, (k * k + k // 5) % 9) for k in range(60)])
    built, two_hop = [], analytics.two_hop
    monkeypatch.setattr(analytics, "two_hop", lambda *a, **k: built.append(1) or two_hop(*a, **k))
    assert same_as_sql(spark, con, tmp_path, f"analytic_{number}")
    assert len(built) == (number == "G2I1_pagerank")


@needs_data
@pytest.mark.parametrize("name", ["olap_O7", "olap_O9", "workload_W4_tree"])
def test_joins_that_make_many_rows_use_all_cores(spark, name):
    """The tables are files that one task reads each; the pairs must not all be made by it."""
    assert catalogue.QUERIES[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_every_query_has_its_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("pipeline_file", [False, True])
def test_entry_works_without_the_training_data_operators(tmp_path, pipeline_file):
    """The folders removed, the entry imports and lists the other queries, whether or not the pipeline's file is still there."""
    shutil.copytree(f"{ROOT}/weftline", tmp_path / "weftline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline_file:
        if not os.path.exists(f"{ROOT}/corpus_pipeline.py"):
            pytest.skip("no pipeline")
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:3] in ('op1', 'op2', 'op3') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert out == [str(len(catalogue.QUERIES)), "False", "True"]


@needs_data
def test_flagship(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "revenue", "n"] and df.count() == 3
