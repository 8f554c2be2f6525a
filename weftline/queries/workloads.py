"""Analytic join workloads.

Roles: ``cast_info(person_id, movie_id)`` are the line items' suppliers and parts, ``title`` the parts, ``name`` the suppliers,
and ``movie_keyword(movie_id, keyword_id)`` the line numbers that a part appears with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.relational import natural_join, pairs_join, theta_join
from weftline.plans import multiway
from weftline.plans.inequality import count_less
from weftline.queries.registry import KEYS, query, table

_CAST = "SELECT l_suppkey AS person_id, l_partkey AS movie_id FROM lineitem"
_TITLE = "SELECT p_partkey AS movie_id, p_name AS movie_name FROM part"
_KEYWORD = "SELECT DISTINCT l_partkey AS movie_id, l_linenumber AS keyword_id FROM lineitem"
_NAME = "SELECT s_suppkey AS person_id, s_name AS name FROM supplier"
_ROLES = f"WITH c AS ({_CAST}), t AS ({_TITLE}), k AS ({_KEYWORD}), n AS ({_NAME}) "


class Roles:
    def __init__(self, spark: SparkSession, folder: str):
        line = table(spark, folder, "lineitem")
        self.cast = line.select(F.col("l_suppkey").alias("person_id"), F.col("l_partkey").alias("movie_id"))
        self.title = table(spark, folder, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("movie_name"))
        self.keyword = line.select(F.col("l_partkey").alias("movie_id"), F.col("l_linenumber").alias("keyword_id")).distinct()
        self.name = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))
        self.size = table(spark, folder, "part").select(F.col("p_partkey").alias("movie_id"), F.col("p_size").alias("keyword_id"))


def _olap(name: str, sql: str):
    return query(f"olap_{name}", _ROLES + sql)


@_olap("O1", "SELECT movie_id, count(*) AS n FROM c GROUP BY movie_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return multiway.count_by([Roles(spark, folder).cast], ["movie_id"])


@_olap("O2", "SELECT * FROM c NATURAL JOIN t")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return natural_join(r.cast, r.title)


@_olap("O3", "SELECT movie_name, count(*) AS n FROM c NATURAL JOIN t GROUP BY movie_name")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return multiway.count_by([r.cast, r.title], ["movie_name"])


@_olap("O4", "SELECT * FROM c NATURAL JOIN t NATURAL JOIN k")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return multiway.joined([r.cast, r.title, r.keyword])


@_olap("O5", "SELECT movie_name, count(*) AS n FROM c NATURAL JOIN t NATURAL JOIN k GROUP BY movie_name")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return multiway.count_by([r.cast, r.title, r.keyword], ["movie_name"])


@_olap("O6", "SELECT movie_name, count(*) AS n FROM c NATURAL JOIN t NATURAL JOIN k NATURAL JOIN n GROUP BY movie_name")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return multiway.count_by([r.cast, r.title, r.keyword, r.name], ["movie_name"])


_S = "SELECT s_suppkey AS movie_id1, s_nationkey AS keyword_id FROM supplier"
_P = "SELECT p_partkey AS movie_id2, p_name AS movie_name FROM part"


def _theta(spark: SparkSession, folder: str) -> DataFrame:
    few = table(spark, folder, "supplier").selectExpr("s_suppkey AS movie_id1", "s_nationkey AS keyword_id")
    many = table(spark, folder, "part").selectExpr("p_partkey AS movie_id2", "p_name AS movie_name")
    return pairs_join(many, few, "movie_id1 < movie_id2").select(*few.columns, *many.columns)


@query("olap_O7", f"SELECT * FROM ({_S}) JOIN ({_P}) ON movie_id1 < movie_id2")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return _theta(spark, folder)


@query("olap_O8", f"SELECT movie_name, count(*) AS n FROM ({_S}) JOIN ({_P}) ON movie_id1 < movie_id2 GROUP BY movie_name")
def _(spark: SparkSession, folder: str) -> DataFrame:
    few = table(spark, folder, "supplier").selectExpr("s_suppkey AS movie_id1")
    many = table(spark, folder, "part").selectExpr("p_partkey AS movie_id2", "p_name AS movie_name")
    counted = count_less(few, "movie_id1", many, "movie_id2").groupBy("movie_name").agg(F.sum("n").alias("n"))
    return counted.where("n > 0")


@_olap("O9", "SELECT q.movie_id, keyword_id, movie_name, person_id, name FROM (SELECT p_partkey AS movie_id, p_size AS keyword_id FROM part) q NATURAL JOIN t JOIN n ON person_id < q.movie_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    return pairs_join(natural_join(r.size, r.title), r.name, "person_id < movie_id")


@_olap("O10", """
    SELECT movie_name, CAST(sum(d) AS BIGINT) AS n FROM c NATURAL JOIN t NATURAL JOIN (SELECT person_id, count(*) AS d FROM c GROUP BY person_id) GROUP BY movie_name
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    again = r.cast.toDF("person_id", "movie_id2")
    return multiway.count_by([r.cast, again, r.title], ["movie_name"])


@_olap("O11", """
    , d AS (SELECT person_id, count(*) AS d FROM c GROUP BY person_id), m AS (SELECT movie_id, CAST(sum(d) AS BIGINT) AS m FROM c NATURAL JOIN d GROUP BY movie_id)
    SELECT name, CAST(sum(m) AS BIGINT) AS n FROM c NATURAL JOIN m NATURAL JOIN n GROUP BY name
""".strip())  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    second, third = r.cast.toDF("person_id2", "movie_id"), r.cast.toDF("person_id2", "movie_id2")
    return multiway.count_by([r.cast, second, third, r.name], ["name"])


@_olap("O12", """
    , d AS (SELECT movie_id, count(*) AS d FROM k GROUP BY movie_id), p AS (SELECT person_id, CAST(sum(d) AS BIGINT) AS p FROM c NATURAL JOIN d GROUP BY person_id)
    SELECT name, CAST(sum(p * p) AS BIGINT) AS n FROM p NATURAL JOIN n GROUP BY name
""".strip())  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = Roles(spark, folder)
    again, keyword2 = r.cast.toDF("person_id", "movie_id2"), r.keyword.toDF("movie_id2", "keyword_id2")
    return multiway.count_by([r.cast, again, r.keyword, keyword2, r.name], ["name"])


# -- join shapes

_SHAPES: dict[str, list[tuple[str, str]]] = {
    "W1_star": [
        ("lineitem", "l_orderkey AS a, l_partkey AS b, l_suppkey AS c, l_linenumber AS d"), ("orders", "o_orderkey AS a, o_custkey AS w1"),
        ("part", "p_partkey AS b, p_size AS w2"), ("supplier", "s_suppkey AS c, s_nationkey AS w3"), ("region", "r_regionkey AS d, r_name AS w4"),
    ],
    "W2_snowflake": [
        ("lineitem", "l_orderkey AS a, l_partkey AS b"), ("orders", "o_orderkey AS a, o_custkey AS c"), ("part", "p_partkey AS b, p_size AS w1"),
        ("customer", "c_custkey AS c, c_nationkey AS d"), ("nation", "n_nationkey AS d, n_name AS w2"),
    ],
    "W3_line": [
        ("region", "r_name AS a, r_regionkey AS b"), ("nation", "n_regionkey AS b, n_nationkey AS c"), ("customer", "c_nationkey AS c, c_custkey AS d"),
        ("orders", "o_custkey AS d, o_orderkey AS e"), ("lineitem", "l_orderkey AS e, l_partkey AS f"),
    ],
    "W4_tree": [
        ("region", "r_regionkey AS a, r_name AS w1"), ("nation", "n_regionkey AS a, n_nationkey AS b"), ("supplier", "s_nationkey AS b, s_suppkey AS w2"),
        ("customer", "c_nationkey AS b, c_custkey AS c"), ("orders", "o_custkey AS c, o_orderkey AS w3"),
    ],
}
_SHAPES["W5_cycle"] = [
    ("lineitem", "l_orderkey AS o, l_suppkey AS s"), ("orders", "o_orderkey AS o, o_custkey AS c"), ("customer", "c_custkey AS c, c_nationkey AS n"),
    ("nation", "n_nationkey AS n, n_regionkey AS r"), ("supplier_region", "s_suppkey AS s, n_regionkey AS r"),
]
_SUPPLIER_REGION = "(SELECT * FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _relation(spark: SparkSession, folder: str, name: str, columns: str) -> DataFrame:
    if name == "supplier_region":
        rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    else:
        rows = table(spark, folder, name)
    return rows.selectExpr(*columns.split(", "))


def _from(parts: list[tuple[str, str]]) -> str:
    return " NATURAL JOIN ".join(f"(SELECT {columns} FROM {_SUPPLIER_REGION if name == 'supplier_region' else name}) q{k}" for k, (name, columns) in enumerate(parts))


def _keys_of(parts: list[tuple[str, str]]) -> dict[str, list[str]]:
    named = {str(k): dict(c.split(" AS ") for c in text.split(", ")) for k, (_, text) in enumerate(parts)}
    return {
        str(k): [named[str(k)][c] for c in KEYS[name]] for k, (name, _) in enumerate(parts) if name in KEYS and all(c in named[str(k)] for c in KEYS[name])
    }


def _in_key_order(parts: list[tuple[str, str]]) -> list[int]:
    """Each next relation joined on its primary key where possible."""
    columns = {str(k): [c.split(" AS ")[1] for c in text.split(", ")] for k, (_, text) in enumerate(parts)}
    return [int(k) for k in multiway.key_first_order(columns, _keys_of(parts))]


for _name, _parts in _SHAPES.items():

    @query(f"workload_{_name}", f"SELECT * FROM {_from(_parts)}")
    def _(spark: SparkSession, folder: str, parts: list[tuple[str, str]] = _parts) -> DataFrame:
        relations = [_relation(spark, folder, *p) for p in parts]
        keys = _keys_of(parts)
        out = relations[(order := _in_key_order(parts))[0]]
        for k in order[1:]:
            # On other columns than its key, a relation has many partners for each row: they aren't brought together by a shuffle.
            many = str(k) in keys and not set(keys[str(k)]) <= set(out.columns)
            out = pairs_join(out, relations[k]) if many else natural_join(out, relations[k])
        return out


_R1, _R2, _R3 = "SELECT n_nationkey AS a, n_regionkey AS b FROM nation", "SELECT n_regionkey AS c, n_nationkey AS d FROM nation", "SELECT s_nationkey AS e, s_suppkey AS f FROM supplier"


def _three(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nation, supplier = table(spark, folder, "nation"), table(spark, folder, "supplier")
    return (
        nation.selectExpr("n_nationkey AS a", "n_regionkey AS b"),
        nation.selectExpr("n_regionkey AS c", "n_nationkey AS d"),
        supplier.selectExpr("s_nationkey AS e", "s_suppkey AS f"),
    )


@query("workload_W6_theta", f"SELECT * FROM ({_R1}) JOIN ({_R2}) ON b < c JOIN ({_R3}) ON d < e")
def _(spark: SparkSession, folder: str) -> DataFrame:
    x, y, z = _three(spark, folder)
    return theta_join(theta_join(x, y, "b < c"), z, "d < e")


@query("workload_W7_theta_project", f"SELECT * FROM (SELECT DISTINCT a, d FROM ({_R1}) JOIN ({_R2}) ON b < c) JOIN ({_R3}) ON d < e")
def _(spark: SparkSession, folder: str) -> DataFrame:
    x, y, z = _three(spark, folder)
    return theta_join(theta_join(x, y, "b < c").select("a", "d").distinct(), z, "d < e")


@query("workload_W8_theta_count", f"SELECT * FROM (SELECT a, d, count(*) AS n FROM ({_R1}) JOIN ({_R2}) ON b < c GROUP BY a, d) JOIN ({_R3}) ON d < e")
def _(spark: SparkSession, folder: str) -> DataFrame:
    x, y, z = _three(spark, folder)
    return theta_join(theta_join(x, y, "b < c").groupBy("a", "d").agg(F.count(F.lit(1)).alias("n")), z, "d < e")


_LINE = [
    ("nation", "n_regionkey AS a, n_nationkey AS b"), ("customer", "c_nationkey AS b, c_custkey AS c"), ("orders", "o_custkey AS c, o_orderkey AS d"),
    ("lineitem", "l_orderkey AS d, l_suppkey AS e"), ("supplier", "s_suppkey AS e, s_nationkey AS f"),
]


@query("workload_W9_line_project", f"SELECT * FROM (SELECT DISTINCT a, d FROM {_from(_LINE[:3])}) NATURAL JOIN {_from(_LINE[3:])}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = [_relation(spark, folder, *p) for p in _LINE]
    middle = multiway.joined(r[:3]).select("a", "d").distinct()
    return natural_join(natural_join(middle, r[3]), r[4])


@query("workload_W10_line_count", f"SELECT * FROM (SELECT a, d, count(*) AS n FROM {_from(_LINE[:3])} GROUP BY a, d) NATURAL JOIN {_from(_LINE[3:])}")
def _(spark: SparkSession, folder: str) -> DataFrame:
    r = [_relation(spark, folder, *p) for p in _LINE]
    middle = multiway.count_by(r[:3], ["a", "d"])
    return natural_join(natural_join(middle, r[3]), r[4])
