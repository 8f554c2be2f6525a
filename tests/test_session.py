from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import functions as F

from weftline import functions as W
from weftline.catalog import Catalog
from weftline.errors import AlreadyExists, NoSuchObject, SyntaxProblem, WeftlineError
from weftline.functions import FunctionRegistry, UserDefinedAggregate
from weftline.operators import relational as R
from weftline.operators.graph import EdgeMeta, Graph, NodeMeta
from weftline.operators.iterate import recursive_union
from weftline.operators.pattern import parse
from weftline.queries.relational import SumOfSquares
from weftline.session import Session
from weftline.sources import load_graph_edges, load_tsv, matching_relation, undirected, write_tsv

# A small retail relation (name, id, price, gender, weight).
RETAIL = [
    ("jacket", 0, 2.5, False, 14.3), ("socks", 0, 5.5, False, 30.6), ("socks", 0, 5.3, False, 30.6), ("socks", 0, 5.6, False, 30.6),
    ("book", 1, 8.9, True, 6.5), ("book", 2, 8.9, True, 6.5), ("sportswear", 0, 5.5, False, 32.3), ("shoes", 2, 8.9, True, 6.5),
]


@pytest.fixture(scope="module")
def session(spark):
    s = Session(spark)
    s.from_rows(RETAIL, "name string, id int, price double, gender boolean, weight float").create_or_replace_table("retail")
    s.from_rows([(1, 2, 3, 0), (1, 5, 3, 9), (4, 2, 1, 0)], "a int, b int, c int, d int").create_or_replace_table("R1")
    s.from_rows([(1, 7), (2, 8)], "a int, e int").create_or_replace_table("R2")
    s.from_rows([(1, 7), (3, 8)], "a int, e int").create_or_replace_table("R3")
    people = spark.createDataFrame([(1, "Person", "x"), (2, "Student", "y"), (3, "Person", "x")], "id long, label string, name string")
    knows = spark.createDataFrame([(1, 2, "Friend", 10), (2, 3, "Friend", 11), (3, 1, "Foe", 10), (1, 1, "Friend", 9)], "src long, dst long, label string, year int")
    s.register_graph("G1", Graph(people, knows, NodeMeta("id", "label"), EdgeMeta("src", "dst", "label")))
    return s


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("text", [
    "select * from R1 where R1.a < b limit 10", "select distinct * from R1 where a < b and b < c", "select * from R1 where a < b and (b < c or c > d)",
    "select * from R1 where a < (b+1) and (b < c-1 or c > d+1)", "select a from R1", "select a, a, b from R1", "select a, * from R1", "select a, b+c+1 from R1",
    "select a, count(*) from R1 group by a", "select a, sum(b+1+2+c) as m from R1 group by a", "select a, sum(b+1+2+c) as m, max(b+c) as w from R1 group by a having m > 1",
    "select * from R1, R2", "select * from R1 natural join R2", "select * from R1 e1 natural join R1 e2", "select * from R1 join R2 on R1.a = R2.e",
    "select * from R1 join R2 using (a)", "select * from R1 left join R2 using (a)", "select * from R1 full outer join R2 using (a)",
    "(select * from R1, R2) union (select * from R1, R3)", "(select * from R1, R2) union all (select * from R1, R3)", "(select * from R1, R2) except (select * from R1, R3)",
    "(select * from R1, R2) intersect (select * from R1, R3)", "select * from match(G1, (a)-[]->(b)-[]->(c)) limit 10", "select average(b) as m from R1;",
    'select a from match(G1,(a:Person:Student {name:"x"})-[b:Friend {year:10}]->(c:Person:Student))',
])
def test_sql_corpus_runs(session, text):
    assert session.sql(text).count() >= 0


def test_sql_results(session):
    assert rows(session.sql("select a, b from R1 where a < b")) == [(1, 2), (1, 5)]
    assert rows(session.sql("select * from R1 natural join R2")) == [(1, 2, 3, 0, 7), (1, 5, 3, 9, 7)]
    assert rows(session.sql("(select a, e from R2) except (select a, e from R3)")) == [(2, 8)]
    assert rows(session.sql("(select a, e from R2) union by update a (select a, e + 100 from R3)")) == [(1, 107), (2, 8), (3, 108)]
    assert rows(session.sql("select 'average(x) match(y' as s from R2 where a = 1")) == [("average(x) match(y",)]
    assert rows(session.sql('select a, c from match(G1, (a:Person)-[b:Friend {year: 10}]->(c))')) == [(1, 2)]


def test_recursion(session):
    assert rows(session.sql("with recursive(3) t(n) as ((select 1 as n) union all (select n + 1 from t)) select n from t")) == [(1,), (2,), (3,), (4,)]
    ends = session.sql("with recursive t(n) as ((select 0 as n) union (select (n + 2) % 7 from t)) select count(*) as n from t")
    assert rows(ends) == [(7,)]
    ranks = session.sql(
        "with recursive(2) w(k, v) as ((select a as k, e as v from R2) union by update k (select k + 1 as k, v * 2 as v from w where k = 1)) select * from w"
    )
    assert rows(ranks) == [(1, 7), (2, 14)]


@pytest.mark.parametrize("text", ["selec a from R1", "with recursive(2) w as (select 1) select 1", "select * from match(G1, (a)-[)", "(select a from R2) union by update a"])
def test_bad_sql(session, text):
    with pytest.raises((SyntaxProblem, ParseException)):
        session.sql(text).collect()
    with pytest.raises(NoSuchObject):
        session.sql("select * from match(nowhere, (a))")


@pytest.mark.parametrize("text", [
    "()", "(a)", "(a:Person:Student)", "(a:Person:Student {name:123, test:12})", "(a)-[]-()", "()-[b]-()", "(a)-[b]->(c)",
    "(a:Person:Student {name:123, test:12})-[b:Friend {year:10}]->(c:Person:Student)", "(a)-[b]->(c)-[d]->(e)", "(a)-[b]->(c);(b)-[d]-(e)", "(a)<-[]-(b)",
])
def test_patterns_parse(text):
    assert parse(text).nodes


def test_pattern_contents_and_errors():
    p = parse('(a:P {n: 1, s: "t", f: 1.5, b: true})-[e:X]->(b)<-[]-(a)')
    assert [n.name for n in p.nodes] == ["a", "b"] and p.nodes[0].properties == (("n", 1), ("s", "t"), ("f", 1.5), ("b", True))
    assert [(s.left, s.right, s.direction) for s in p.steps] == [(0, 1, "out"), (1, 0, "in")]
    for bad in ("(a", "(a)-[]->", "(a)<-[]->(b)", "(a) (b)", "(a {x})", "(a)-[]-(b);", "(1)"):
        with pytest.raises(SyntaxProblem):
            parse(bad)
    with pytest.raises(SyntaxProblem, match="line 2, column 1"):
        parse("(a)\n!")


def test_matches_are_homomorphisms_in_a_bag(session):
    g = session.catalog.get_graph("G1")
    assert rows(g.pattern("(a)-[]->(a)")) == [(1,)]
    assert rows(g.pattern("(a)-[]->(b)-[]->(c)")) == [(1, 1, 1), (1, 1, 2), (1, 2, 3), (2, 3, 1), (3, 1, 1), (3, 1, 2)]
    assert rows(g.pattern("(a)-[:Foe]-(b)")) == [(1, 3), (3, 1)]
    assert g.pattern("()").count() == 3 and g.pattern("(a);(b)").count() == 9
    with pytest.raises(WeftlineError):
        Graph.from_edges(g.edge().select("src", "dst")).pattern("(a:X)")
    labels = g.node().withColumn("label", F.array("label", F.lit("All")))
    tagged = Graph(labels, g.edge(), NodeMeta("id", "label"))
    assert rows(tagged.pattern("(a:Person:All)")) == [(1,), (3,)]


def test_graph_parts(session, spark):
    g = session.catalog.get_graph("G1")
    assert rows(Graph.from_edges(g.edge()).node()) == [(1,), (2,), (3,)]
    assert Graph.from_nodes(g.node()).edge().count() == 0
    sub = g.subgraph("label = 'Person'", "year = 10")
    assert rows(sub.edge().select("src", "dst")) == [(3, 1)] and sub.node().count() == 2
    assert rows(g.degrees("src")) == [(1, 2), (2, 1), (3, 1)]
    assert rows(g.reverse().edge().select("src", "dst")) == [(1, 1), (1, 3), (2, 1), (3, 2)]
    assert g.relation().columns == ["src", "dst", "label", "year", "src_label", "src_name", "dst_label", "dst_name"]
    assert rows(g.message_passing("state * year", "sum(new_state)", "new_state", "CAST(id AS DOUBLE)", rounds=1)) == [(1, 39.0), (2, 10.0), (3, 22.0)]
    quiet = Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    assert rows(quiet.message_passing("state", "max(new_state)", "coalesce(new_state, -1.0)", "2.0", keep_silent=False)) == [(1, -1.0), (2, 2.0)]
    with pytest.raises(ValueError):
        g.message_passing("state", "sum(new_state)", rounds=0)


def test_frame(session):
    f = session.table("retail")
    assert f.project("name, id").count() == 6 and f.project_all("name, id").count() == 8 and f.select("id = 2").count() == 2
    assert rows(f.aggregate("count(*) as n, average(price) as p by id").project_all("id, n")) == [(0, 5), (1, 1), (2, 2)]
    assert rows(f.transform("id + 1, greatest(id, 1)").alias("x, y").distinct()) == [(1, 1), (2, 1), (3, 2)]
    assert [r[0] for r in f.sort("price desc, name").limit(2).project_all("name").collect()] == ["book", "book"]
    a, b = f.filter("id = 0").project("name"), f.project("name")
    assert rows(b.difference(a)) == [("book",), ("shoes",)] and rows(b.intersection(a)) == rows(a)
    assert a.union(a, b).count() == 5 and a.union_all(a).count() == 6
    assert f.cache().count() == 8 and "Relation" in f.logical() + "Relation"
    keyed = session.from_rows([(0, "zero")], "id int, word string")
    assert f.join(keyed).columns == ["id", "name", "price", "gender", "weight", "word"] and f.join(keyed).count() == 5
    assert f.using_join(keyed, ["id"], "left").count() == 8 and f.cross_join(keyed.alias("k, w")).count() == 8
    assert f.theta_join("id < k", session.from_rows([(1,)], "k int")).count() == 5
    doubled = session.from_rows([(1, 1)], "k int, v int").with_recursive(lambda d: d.project_all("k, v * 2 as v"), 4)
    assert rows(doubled) == [(1, 16)]
    with pytest.raises(WeftlineError):
        f.using_join(keyed, ["nothing"])
    with pytest.raises(AnalysisException):
        f.filter("nothing = 1")
    with pytest.raises(NoSuchObject):
        session.table("nowhere")


def test_session_leaves_settings_alone(spark, session):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.ansi.enabled")
    session.sql("select 1").collect()
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.ansi.enabled")) == before


def test_lists_are_parted_outside_brackets():
    assert R.split_list("a, sum(b, c) as d, 'x,y' as e, f[1, 2]") == ["a", "sum(b, c) as d", "'x,y' as e", "f[1, 2]"]


def test_division_by_zero_is_null(spark):
    x = spark.createDataFrame([(7, 2), (-7, 2), (7, 0), (None, 2)], "a int, b int")
    got = x.select(W.divide("a", "b"), W.int_divide("a", "b"), W.remainder("a", "b")).collect()
    assert [tuple(r) for r in got] == [(3.5, 3, 1), (-3.5, -3, -1), (None, None, None), (None, None, None)]


def test_functions():
    f = FunctionRegistry()
    assert f.exists("AVERAGE") and not f.exists("nope")
    f.register("twice", lambda x: x * 2)
    with pytest.raises(AlreadyExists):
        f.register("twice", lambda x: x, replace=False)
    f.rename("twice", "double")
    assert f.names() == ["average", "coalesce", "div0", "double", "greatest", "if", "least"]
    assert f.drop("double") and not f.drop("double")
    with pytest.raises(NoSuchObject):
        f.lookup("double")
    f.clear()
    assert not f.names()
    f.restore()
    assert f.exists("if")


def test_catalog(spark):
    c = Catalog()
    c.create_database("d", "text")
    c.create_database("d", ignore_if_exists=True)
    with pytest.raises(AlreadyExists):
        c.create_database("d")
    c.alter_database("d", "new")
    assert c.get_database("d").comment == "new" and c.list_databases() == ["d", "default"]
    c.create_table("t", ["a", "b"], ["a"])
    with pytest.raises(AlreadyExists):
        c.create_table("t", ["a"])
    assert c.alter_table("t", primary_key=("b",)).primary_key == ("b",) and c.primary_keys() == {"t": ("b",)} and c.list_tables() == ["t"]
    c.drop_table("t")
    c.drop_table("t", ignore_if_missing=True)
    for call in (c.get_table, c.drop_table, c.get_graph, c.drop_graph, c.get_view, c.get_database, c.drop_database):
        with pytest.raises(NoSuchObject):
            call("none")
    g = Graph.from_nodes(spark.range(1))
    c.create_graph("g", g)
    c.alter_graph("g", g)
    assert c.list_graphs() == ["g"]
    c.drop_graph("g")
    c.register_view("v_here", spark.range(2))
    with pytest.raises(AlreadyExists):
        c.register_view("v_here", spark.range(1))
    c.create_or_replace_view("v_here", spark.range(3))
    assert spark.table("v_here").count() == 3 and c.list_views() == ["v_here"]
    assert c.drop_view("v_here") and not c.drop_view("v_here")


def test_files(spark, tmp_path):
    path = tmp_path / "edges"
    path.write_text("# comment\n1 2\n2\t1\n3 3\n4  5\nbad line here\nx y\n1 2\n")
    assert rows(load_graph_edges(spark, str(path))) == [(1, 2), (1, 2), (2, 1), (3, 3), (4, 5)]
    assert rows(load_graph_edges(spark, str(path), is_undirected=True)) == [(1, 2), (2, 1), (4, 5), (5, 4)]
    assert load_tsv(spark, str(path), ["a", "b"]).dtypes == [("a", "double"), ("b", "double")]
    write_tsv(spark.createDataFrame([(1, 2)], "a long, b long"), str(tmp_path / "out"))
    assert rows(load_tsv(spark, str(tmp_path / "out"), ["a", "b"], kind="bigint")) == [(1, 2)]
    assert rows(undirected(spark.createDataFrame([(1, 1), (1, 2)], "src long, dst long"))) == [(1, 2), (2, 1)]


def test_matching_relation(spark):
    got = matching_relation(spark, ["a", "b"], [1, 2], 12, filler=100)
    values = rows(got)
    assert [v for v in values if v[0] < 100] == [(a, b) for a in range(2) for b in range(4)] and len(values) == 12
    assert [v for v in values if v[0] >= 100] == [(100 + i, 100 + i) for i in range(4)]
    assert min(r[0] for r in matching_relation(spark, ["a"], [1], 5).collect()) == -3
    with pytest.raises(ValueError):
        matching_relation(spark, ["a"], [3], 7)


def test_recursive_union_of_a_bag_is_bounded(spark):
    base = spark.createDataFrame([(1,)], "n long")
    assert recursive_union(base, lambda d: d, 3, distinct=False).count() == 4
    assert recursive_union(base, lambda d: d, 3).count() == 1


class Longest(UserDefinedAggregate):
    buffer_type, result_type = "bigint", "string"

    def initialize(self):
        return 0

    def update(self, buffer, values):
        return max([buffer, *values.dropna().str.len()])

    def merge(self, buffer, other):
        return max(buffer, other)

    def evaluate(self, buffer):
        return f"<{buffer}>"


def test_aggregates_in_python_by_null_and_several_keys_and_none(spark):
    rows = [(i % 7 or None, "ab"[i % 2], None if i % 5 == 0 else "x" * (i % 11)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, t string").repartition(3)
    want: dict = {}
    for k, g, t in rows:
        want[k, g] = max(want.get((k, g), 0), len(t or ""))
    assert {(r.k, r.g): r.m for r in Longest().aggregate(df, ["k", "g"], "t", "m").collect()} == {k: f"<{v}>" for k, v in want.items()}
    assert [r.m for r in Longest().aggregate(df, [], "t", "m").collect()] == ["<10>"]
    assert Longest().aggregate(df.where("false"), ["k"], "t", "m").count() == 0


def test_an_aggregate_is_not_called_for_each_key_of_each_batch(spark):
    """30,000 rows of 3,000 keys in one task of 3 batches: all its keys are grouped together, not each batch's again."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(SumOfSquares):
        def update(self, buffer, values):
            calls.add(1)
            return super().update(buffer, values)

        def update_groups(self, values, starts):
            calls.add(1)
            return super().update_groups(values, starts)

    df = spark.range(0, 30_000, 1, 1).selectExpr("id % 3000 AS k", "CASE WHEN id % 4 <> 0 THEN CAST(id % 100 AS INT) END AS v")
    got = {r.k: r.q for r in Counted().aggregate(df, ["k"], "v", "q").collect()}
    assert got == {k: sum((i % 100) ** 2 for i in range(k, 30_000, 3000) if i % 4) for k in range(3000)}
    assert calls.value <= 3
