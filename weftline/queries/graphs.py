"""Graph queries over the graph of customers and orders.

Nodes are the customers.  An order is an edge from its customer to the customer that its key maps to; the
graph is made of all orders, self-loops left out and repeated edges once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import analytics as A
from weftline.operators.graph import EdgeMeta, Graph, NodeMeta
from weftline.operators.iterate import assign_rounds
from weftline.operators.relational import natural_join
from weftline.plans import multiway
from weftline.plans.hypercube import hypercube_join
from weftline.plans.materialize import stored
from weftline.plans.multiway import Relation
from weftline.queries.registry import query, session, table
from weftline.sources import undirected

_DST = "(o_orderkey * 31 + 7) % (SELECT count(*) FROM customer)"
EDGES = f"SELECT DISTINCT o_custkey AS src, {_DST} AS dst FROM orders WHERE o_custkey <> {_DST}"
LABELLED = f"SELECT DISTINCT o_custkey AS src, {_DST} AS dst, o_orderstatus AS status FROM orders WHERE o_custkey <> {_DST}"
PAGERANK_ROUNDS = 3
ROUNDS = 20


def _ends(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    n = table(spark, folder, "customer").count()
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 31 + 7) % n).alias("dst"), *[F.col(m) for m in more]
    )
    return rows.where("src <> dst").distinct()


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _ends(spark, folder)


def graph(spark: SparkSession, folder: str) -> Graph:
    nodes = table(spark, folder, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_nationkey AS nation")
    labelled = _ends(spark, folder, "o_orderstatus").withColumnRenamed("o_orderstatus", "status")
    return Graph(nodes, labelled, NodeMeta("id", "segment"), EdgeMeta("src", "dst", "status"))


# -- graphs and patterns

_G = f"WITH e AS ({LABELLED}), v AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation FROM customer) "


def _graph_query(name: str, sql: str, prefix: str = _G) -> Callable:
    return query(name, prefix + sql)


@_graph_query("graph_nodes", "SELECT * FROM v")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).node()


@_graph_query("graph_edges", "SELECT * FROM e")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).edge()


@_graph_query("graph_nodes_of_edges", "SELECT src AS id FROM e UNION SELECT dst FROM e")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return Graph.from_edges(edges(spark, folder)).node()


@_graph_query("graph_relation", """
    SELECT e.*, a.segment AS src_segment, a.nation AS src_nation, b.segment AS dst_segment, b.nation AS dst_nation
    FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).relation()


@_graph_query("graph_subgraph", "SELECT e.* FROM e JOIN v a ON src = a.id JOIN v b ON dst = b.id WHERE status <> 'P' AND a.nation < 12 AND b.nation < 12")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).subgraph("nation < 12", "status <> 'P'").edge()


@_graph_query("graph_degrees", "SELECT dst, count(*) AS degree FROM e GROUP BY dst")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).degrees("dst")


@_graph_query("graph_undirected", "SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return undirected(edges(spark, folder))


def _pattern(name: str, pattern: str, sql: str, properties: bool = False) -> None:
    _graph_query(name, sql)(lambda spark, folder: graph(spark, folder).pattern(pattern, properties))


_pattern("pattern_node", "(a:BUILDING)", "SELECT id AS a FROM v WHERE segment = 'BUILDING'")
_pattern("pattern_edge", "(a)-[]->(b)", "SELECT src AS a, dst AS b FROM e")
_pattern("pattern_reversed", "(a)<-[:F]-(b)", "SELECT dst AS a, src AS b FROM e WHERE status = 'F'")
_pattern("pattern_both_ways", "(a)-[:P]-(b)", "SELECT src AS a, dst AS b FROM e WHERE status = 'P' UNION ALL SELECT dst, src FROM e WHERE status = 'P'")
_pattern("pattern_two_hops", "(a)-[:P]->(b)-[:F]->(c)", "SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON x.dst = y.src WHERE x.status = 'P' AND y.status = 'F'")
_pattern("pattern_labels", "(a:BUILDING:MACHINERY {nation: 3})-[b:F]->(c:AUTOMOBILE)", """
    SELECT src AS a, dst AS c FROM e JOIN v x ON src = x.id JOIN v y ON dst = y.id
    WHERE x.segment IN ('BUILDING', 'MACHINERY') AND x.nation = 3 AND status = 'F' AND y.segment = 'AUTOMOBILE'
""")  # fmt: skip
_pattern("pattern_paths", "(a:BUILDING)-[:P]->(b);(c:MACHINERY)-[:P]->(b)", """
    SELECT x.src AS a, x.dst AS b, y.src AS c FROM e x JOIN e y ON x.dst = y.dst JOIN v p ON x.src = p.id JOIN v q ON y.src = q.id
    WHERE x.status = 'P' AND y.status = 'P' AND p.segment = 'BUILDING' AND q.segment = 'MACHINERY'
""")  # fmt: skip
_pattern("pattern_triangle", "(a)-[]->(b)-[]->(c)-[]->(a)", "SELECT x.src AS a, y.src AS b, z.src AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src")
_pattern("pattern_properties", "(a)-[e]->(b {nation: 5})", """
    SELECT src AS a, dst AS b, status AS e_status, x.segment AS a_segment, x.nation AS a_nation, y.segment AS b_segment, y.nation AS b_nation
    FROM e JOIN v x ON src = x.id JOIN v y ON dst = y.id WHERE y.nation = 5
""", properties=True)  # fmt: skip


@_graph_query("pattern_in_sql", """
    SELECT x.src AS a, count(*) AS n FROM e x JOIN e y ON x.dst = y.src JOIN v p ON x.src = p.id WHERE p.segment = 'HOUSEHOLD' GROUP BY x.src
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    s = session(spark, folder).register_graph("shop", graph(spark, folder))
    return s.sql("select a, count(*) as n from match(shop, (a:HOUSEHOLD)-[]->(b)-[]->(c)) group by a").df


@_graph_query("message_passing", """
    , m AS (SELECT dst AS id, sum(a.nation * 2) AS s FROM e JOIN v a ON src = a.id WHERE true GROUP BY dst), s1 AS (
        SELECT v.id, CASE WHEN m.s IS NULL THEN v.nation ELSE v.nation + m.s END AS state FROM v LEFT JOIN m USING (id)
    ), m2 AS (SELECT dst AS id, sum(s1.state * 2) AS s FROM e JOIN s1 ON src = s1.id GROUP BY dst)
    SELECT s1.id, CAST(CASE WHEN m2.s IS NULL THEN s1.state ELSE s1.state + m2.s END AS BIGINT) AS state FROM s1 LEFT JOIN m2 USING (id)
""", _G.rstrip())  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    return graph(spark, folder).message_passing("state * 2", "sum(new_state)", "state + new_state", "CAST(nation AS BIGINT)", rounds=2)


# -- counting subgraphs: each letter pair is a copy of the edges; the shapes are fixed values, given by the acceptance queries

SHAPES = {
    "S1": "ab bc ca", "S2": "ab bc ca cd", "S3": "ab bc cd da bd", "S4": "ab bc cd da ac bd", "S5": "ab bc cd de ae be",
    "S6": "ab bc cd de ae be ce", "S7": "ab bc cd de ae ac bd ce", "S8": "ab bc cd de ae bd be ce",
}


def copies(e: DataFrame, shape: str) -> list[DataFrame]:
    return [e.toDF(x[0], x[1]) for x in shape.split()]


def join_sql(shape: str) -> str:
    """The natural join of the shape's copies of ``e``, as a FROM clause over distinct attributes."""
    parts, first = [], {}
    for k, (x, y) in enumerate(shape.split()):
        conditions = [f"{first[v]} = e{k}.{side}" for v, side in ((x, "src"), (y, "dst")) if v in first]
        parts.append(f"e e{k}" if not parts else f"JOIN e e{k} ON {' AND '.join(conditions) or 'true'}")
        first.setdefault(x, f"e{k}.src")
        first.setdefault(y, f"e{k}.dst")
    return f"(SELECT {', '.join(f'{c} AS {v}' for v, c in sorted(first.items()))} FROM {' '.join(parts)})"


#: The order of edges for the SQL texts: cycles first.
_SQL_ORDER = {"S5": "ab ae be bc de cd", "S6": "ab ae be bc ce cd de", "S7": "ab bc ac cd bd de ae ce", "S8": "ab ae be bc ce cd bd de", "S4": "ab bc ac cd da bd", "S3": "ab bd da bc cd"}
_E = f"WITH e AS ({EDGES}) "


def _shape_sql(name: str) -> str:
    return join_sql(_SQL_ORDER.get(name, SHAPES[name]))


for _name, _shape in SHAPES.items():
    query(f"subgraph_{_name}", f"{_E}SELECT a, count(*) AS n FROM {_shape_sql(_name)} GROUP BY a")(
        lambda spark, folder, shape=_shape: multiway.count_by(copies(edges(spark, folder), shape), ["a"])
    )

for _name, _of, _keep, _by in (("C1", "S5", "bd", "b"), ("C2", "S6", "bc", "b")):
    query(f"subgraph_{_name}", f"{_E}SELECT {_by}, count(*) AS n FROM (SELECT DISTINCT {', '.join(_keep)} FROM {_shape_sql(_of)}) GROUP BY {_by}")(
        lambda spark, folder, shape=SHAPES[_of], keep=_keep, by=_by: multiway.distinct_pairs_then_count(copies(edges(spark, folder), shape), list(keep), by)
    )

for _name, _of in (("C3", "S5"), ("C4", "S6")):

    @query(f"subgraph_{_name}", f"{_E}SELECT a, CAST(sum(c_nationkey) AS BIGINT) AS s FROM {_shape_sql(_of)} JOIN customer ON c_custkey = d GROUP BY a")
    def _(spark: SparkSession, folder: str, shape: str = SHAPES[_of]) -> DataFrame:
        weights = table(spark, folder, "customer").selectExpr("c_custkey AS d", "CAST(c_nationkey AS BIGINT) AS w")
        parts = [Relation(c, tuple(c.columns)) for c in copies(edges(spark, folder), shape)]
        return multiway.sum_product([*parts, Relation(weights, ("d",), "w")], ["a"], "s")


@query("multiway_cyclic_rows", f"{_E}SELECT * FROM {_shape_sql('S2')}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return multiway.joined(copies(edges(spark, folder), SHAPES["S2"]), list("abcd"))


@query("multiway_hypercube_leapfrog", f"{_E}SELECT * FROM {_shape_sql('S1')}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return hypercube_join(copies(stored(edges(spark, folder)), SHAPES["S1"]), order=list("abc"))


# -- iterative analytics


def _pagerank_sql(e: str, rounds: int) -> str:
    steps = [f"g AS ({e})", "deg AS (SELECT dst, CAST(1 AS DOUBLE) / count(*) AS degree FROM g GROUP BY dst)", "w0 AS (SELECT dst, CAST(1 AS DOUBLE) AS weight FROM deg)"]
    for k in range(rounds):
        steps.append(
            f"w{k + 1} AS (SELECT src AS dst, 0.85::DOUBLE * sum(weight * degree) + 0.15::DOUBLE AS weight FROM w{k} JOIN deg USING (dst) JOIN g USING (dst) GROUP BY src)"
        )
    return f"WITH e AS ({EDGES}), {', '.join(steps)} SELECT dst, round(weight, 6) AS weight FROM w{rounds}"


def _spread_sql(e: str, first: str, add: int) -> str:
    """Least values spread against the edges, round by round."""
    steps = [f"g AS MATERIALIZED (SELECT DISTINCT * FROM ({e}))", f"w1 AS MATERIALIZED ({first})"]
    for k in range(1, ROUNDS):
        steps.append(
            f"w{k + 1} AS MATERIALIZED (SELECT src, min(weight) AS weight FROM (SELECT src, weight FROM w{k} UNION ALL "
            f"SELECT g.src, w.weight + {add} FROM g JOIN w{k} w ON g.dst = w.src) GROUP BY src)"
        )
    return f"WITH e AS ({EDGES}), {', '.join(steps)} SELECT src, CAST(weight AS BIGINT) AS weight FROM w{ROUNDS}"


_LABELS = "SELECT src, min(dst) AS weight FROM g WHERE dst IN (SELECT src FROM g) GROUP BY src"
_HOPS = "SELECT DISTINCT src, 1 AS weight FROM g WHERE dst = 0"
_TWO = "SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src"
#: The graph's SQL, the edges of a step, and whether pairs of ends count once.
_GRAPHS = {"I": ("SELECT * FROM e", 1, True), "G1I": (_TWO, 2, False), "G2I": (f"SELECT DISTINCT * FROM ({_TWO})", 2, True)}


def _pagerank(g: DataFrame, hops: int, distinct: bool) -> DataFrame:
    if hops == 2:
        weights = A.two_hop_pagerank(g, PAGERANK_ROUNDS, distinct)
    else:
        degree = g.groupBy("dst").agg((F.lit(1.0) / F.count(F.lit(1))).alias("degree"))
        weights = A.pagerank(g, degree, degree.select("dst", F.lit(1.0).alias("weight")), PAGERANK_ROUNDS)
    # The last bits of a sum hang on the order of its rows: without them, weights at half a millionth go up, as their exact values do.
    return weights.select("dst", F.round(F.round("weight", 12), 6).alias("weight"))


def _loop_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The edges, stored: every round reads them."""
    return stored(edges(spark, folder))


for _name, (_sql, _hops, _once) in _GRAPHS.items():
    query(f"analytic_{_name}1_pagerank", _pagerank_sql(_sql, PAGERANK_ROUNDS))(
        lambda spark, folder, hops=_hops, once=_once: _pagerank(_loop_edges(spark, folder), hops, once)
    )
    query(f"analytic_{_name}2_components", _spread_sql(_sql, _LABELS, 0))(
        lambda spark, folder, hops=_hops: A.components(_loop_edges(spark, folder), ROUNDS, hops)
    )
    query(f"analytic_{_name}3_shortest_hops", _spread_sql(_sql, _HOPS, 1))(
        lambda spark, folder, hops=_hops: A.shortest_hops(_loop_edges(spark, folder), 0, ROUNDS, hops)
    )


@query("iterate_assign", f"""
    {_E}, w1 AS (SELECT src, count(*) AS n FROM e GROUP BY src), w2 AS (SELECT e.src, CAST(sum(n) AS BIGINT) AS n FROM e JOIN w1 ON e.dst = w1.src GROUP BY e.src)
    SELECT src, n FROM w2
""".replace(") , w1", "), w1"))  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    e = edges(spark, folder)
    # One for every end of an edge, also for those without an edge out: the first round counts all edges.
    ones = e.select(F.col("dst").alias("src")).distinct().withColumn("n", F.lit(1).cast("long"))

    def step(w: DataFrame) -> DataFrame:
        return natural_join(e, w.withColumnRenamed("src", "dst")).groupBy("src").agg(F.sum("n").alias("n"))

    return assign_rounds(ones, step, 2)
