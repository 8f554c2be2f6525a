"""Rows, expressions, joins, sets, aggregates, subqueries and functions."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import functions as W
from weftline.functions import UserDefinedAggregate
from weftline.operators import relational as R
from weftline.plans.materialize import shared_folder
from weftline.queries.registry import query, session, sql_query, table
from weftline.sources import load_graph_edges, load_tsv, matching_relation, write_tsv

# -- scans, rows

FLAGSHIP = """
    SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n
    FROM lineitem WHERE l_quantity < 24 GROUP BY l_returnflag
"""
sql_query("agg_filter_group", FLAGSHIP)
sql_query("scan_all_columns", "SELECT * FROM orders")
sql_query("row_filter_and_or", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity < 10 AND (l_discount > 0.05 OR l_tax = 0)")
sql_query("row_filter_arithmetic", "SELECT p_partkey, p_size FROM part WHERE p_size < (p_partkey % 50 + 1) AND (p_size < 40 - 1 OR p_partkey > p_size + 1)")
sql_query("row_project_bag", "SELECT l_returnflag, l_linestatus FROM lineitem")
sql_query("row_project_repeated", "SELECT n_regionkey AS a, n_regionkey AS a2, n_name AS b FROM nation")
sql_query("row_distinct_star", "SELECT DISTINCT * FROM nation WHERE n_nationkey < 20 AND n_regionkey < n_nationkey")
sql_query("row_qualified_star", "SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name < 'B'")
sql_query("row_derived_table", "SELECT t.k, t.total FROM (SELECT o_custkey AS k, count(*) AS total FROM orders GROUP BY o_custkey) AS t WHERE t.total > 8")
sql_query("row_sort_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
sql_query("row_order_by_mixed", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey")


@query("row_project_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber + 1 AS next FROM lineitem")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return session(spark, folder).table("lineitem").project("l_returnflag, l_linestatus, l_linenumber + 1 as next").df


@query("row_select_is_filter", "SELECT * FROM supplier WHERE s_acctbal < 0")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return session(spark, folder).table("supplier").select("s_acctbal < 0").df


@query("row_transform_rename", "SELECT s_suppkey AS k, 2 * s_nationkey + 1 AS v FROM supplier")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return session(spark, folder).table("supplier").transform("s_suppkey, 2 * s_nationkey + 1").alias("k, v").df


@query("row_top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return R.top_k(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), 10, [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("row_limit_of_limit", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 7")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return session(spark, folder).table("part").sort("p_partkey").limit(7).limit(20).project_all("p_partkey").df


@query("source_matching_rows", """
    SELECT CASE WHEN id < 64 THEN id // 16 ELSE -1 - (id - 64) END AS a, CASE WHEN id < 64 THEN id // 4 % 4 ELSE -1 - (id - 64) END AS b,
           CASE WHEN id < 64 THEN id % 4 ELSE -1 - (id - 64) END AS c FROM range(1000) t(id)
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    return matching_relation(spark, ["a", "b", "c"], [2, 2, 2], 1000)


@query("source_tsv_round_trip", "SELECT o_orderkey AS a, o_custkey AS b FROM orders")
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tsv-{uuid.uuid4().hex}"
    write_tsv(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), path)
    return load_tsv(spark, path, ["a", "b"], kind="bigint")


@query("source_graph_file", """
    WITH e AS (SELECT c_nationkey AS src, c_custkey % 25 AS dst FROM customer WHERE c_nationkey <> c_custkey % 25) SELECT src, dst FROM e UNION SELECT dst, src FROM e
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/edges-{uuid.uuid4().hex}"
    write_tsv(table(spark, folder, "customer").selectExpr("c_nationkey", "c_custkey % 25"), path)
    return load_graph_edges(spark, path, is_undirected=True)


# -- expressions

sql_query("expr_arithmetic", "SELECT p_partkey, p_size + 3 * p_partkey - 1 AS a, -p_size AS b, +p_size AS c, p_size * 0.5 AS d FROM part",
          "SELECT p_partkey, p_size + 3 * p_partkey - 1 AS a, -p_size AS b, +p_size AS c, CAST(p_size * 0.5 AS DECIMAL(12,1)) AS d FROM part")
sql_query("expr_compare", "SELECT n_nationkey, n_nationkey = n_regionkey AS e, n_nationkey != n_regionkey AS ne, n_nationkey <= 2 * n_regionkey AS le, NOT (n_nationkey > 10) AS ng FROM nation")
sql_query("expr_literals", "SELECT n_nationkey, 12 AS i, 1.5D AS d, 'text' AS s, true AS t, CAST(NULL AS STRING) AS x FROM nation",
          "SELECT n_nationkey, 12 AS i, CAST(1.5 AS DOUBLE) AS d, 'text' AS s, true AS t, CAST(NULL AS VARCHAR) AS x FROM nation")
sql_query("expr_three_valued", """
    SELECT n_nationkey, (n_nationkey > 5 AND CAST(NULL AS BOOLEAN)) AS a, (n_nationkey > 5 OR CAST(NULL AS BOOLEAN)) AS o, NOT CAST(NULL AS BOOLEAN) AS n FROM nation
""")
sql_query("expr_in_list", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) AND n_name NOT IN ('x', 'y')")
sql_query("expr_in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
sql_query("expr_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
sql_query("expr_not_exists", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
sql_query("expr_scalar_subquery", "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT avg(s_acctbal) FROM supplier)")
sql_query("expr_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS kind FROM part")


@query("expr_division", """
    SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) / nullif(n_regionkey, 0) AS q, n_nationkey // nullif(n_regionkey, 0) AS i,
           n_nationkey % nullif(n_regionkey, 0) AS r, -n_nationkey // nullif(n_regionkey, 0) AS j FROM nation
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, folder, "nation").select(
        "n_nationkey", W.divide(n, r).alias("q"), W.int_divide(n, r).alias("i"), W.remainder(n, r).alias("r"), W.int_divide(-n, r).alias("j")
    )


@query("expr_greatest_least_coalesce", """
    WITH x AS (SELECT o_orderkey, o_custkey, c_custkey, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey)
    SELECT o_orderkey, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS l, coalesce(c_nationkey, -1) AS c,
           CASE WHEN c_nationkey > 10 THEN 1 ELSE 0 END AS i FROM x
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    rich = table(spark, folder, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(rich, "o_custkey", "left")
    n = F.col("c_nationkey")
    return rows.select(
        "o_orderkey", F.greatest(n, F.lit(10)).alias("g"), F.least(n, F.lit(10)).alias("l"), F.coalesce(n, F.lit(-1)).alias("c"),
        W.choose(n > 10, 1, 0).alias("i"),
    )


@query("expr_cast", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS s, TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand,
           TRY_CAST(p_name AS INTEGER) AS none, p_size > 0 AS b FROM part
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("d"), F.col("p_partkey").cast("string").alias("s"),
        F.substring("p_brand", 7, 10).try_cast("int").alias("brand"), F.col("p_name").try_cast("int").alias("none"),
        F.col("p_size").cast("boolean").alias("b"),
    )


@query("expr_is_null", """
    SELECT c_custkey, o_orderkey IS NULL AS missing, o_orderkey IS NOT NULL AS there
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 450000) o ON o_custkey = c_custkey
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    dear = table(spark, folder, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = table(spark, folder, "customer").select("c_custkey").join(dear, "c_custkey", "left")
    return rows.select("c_custkey", F.col("o_orderkey").isNull().alias("missing"), F.col("o_orderkey").isNotNull().alias("there"))


# -- aggregates

sql_query("agg_global", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_custkey) AS s, avg(o_custkey) AS m FROM orders")
sql_query("agg_having_alias", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12")
sql_query("agg_compound", "SELECT l_returnflag, sum(l_linenumber + 1 + 2) + 1 AS m, max(l_partkey) - min(l_partkey) AS w FROM lineitem GROUP BY l_returnflag")
sql_query("agg_average_name", "SELECT l_suppkey, average(l_partkey) AS m FROM lineitem GROUP BY l_suppkey", "SELECT l_suppkey, avg(l_partkey) AS m FROM lineitem GROUP BY l_suppkey")
sql_query("agg_distinct_count", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY l_suppkey")
sql_query("agg_count_null", """
    SELECT c_nationkey, count(*) AS rows_, count(o_orderkey) AS orders_, min(o_orderkey) AS first_, sum(o_orderkey) AS sum_
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 490000) o ON o_custkey = c_custkey GROUP BY c_nationkey
""")


@query("agg_frame", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_linenumber) AS s, avg(l_partkey) AS m FROM lineitem GROUP BY ALL")
def _(spark: SparkSession, folder: str) -> DataFrame:
    rows = session(spark, folder).table("lineitem")
    return rows.aggregate("count(*) as n, sum(l_linenumber) as s, average(l_partkey) as m by l_returnflag, l_linestatus").df


# -- joins

sql_query("join_inner_on", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql_query("join_inner_residual", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice < o_totalprice / 4")
sql_query("join_comma_where", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey")
sql_query("join_cross", "SELECT n_name, r_name FROM nation CROSS JOIN region")
sql_query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
sql_query("join_right", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 400000")
sql_query("join_self_alias", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql_query("join_theta", "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_suppkey < n_nationkey")
sql_query("join_full_using", """
    SELECT k, a, b FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) x
    FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) y USING (k)
""")
sql_query("join_null_keys", """
    SELECT a.k, a.v, b.w FROM (SELECT nullif(n_regionkey, 0) AS k, n_name AS v FROM nation) a
    JOIN (SELECT nullif(r_regionkey, 0) AS k, r_name AS w FROM region) b ON a.k = b.k
""")

_PAIRS = "(SELECT DISTINCT l_suppkey AS s, l_linenumber AS line FROM lineitem)"


@query("join_natural", "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier)")
def _(spark: SparkSession, folder: str) -> DataFrame:
    s = session(spark, folder)
    return s.table("nation").project_all("n_nationkey as k, n_name").join(s.table("supplier").project_all("s_nationkey as k, s_suppkey")).df


@query("join_using_left", "SELECT k, n_name, s_suppkey FROM (SELECT n_nationkey AS k, n_name FROM nation) LEFT JOIN (SELECT s_nationkey AS k, s_suppkey FROM supplier WHERE s_acctbal > 3000) USING (k)")
def _(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").selectExpr("n_nationkey as k", "n_name")
    rich = table(spark, folder, "supplier").where("s_acctbal > 3000").selectExpr("s_nationkey as k", "s_suppkey")
    return R.using_join(nations, rich, ["k"], "left")


@query("join_small_side", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey")
    return R.small_join(orders, customers, ["k"]).select("o_orderkey", "c_nationkey")


@query("join_semi", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(spark: SparkSession, folder: str) -> DataFrame:
    many = table(spark, folder, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return R.using_join(table(spark, folder, "part").select("p_partkey", "p_name"), many, ["p_partkey"], "left_semi")


@query("join_anti", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def _(spark: SparkSession, folder: str) -> DataFrame:
    many = table(spark, folder, "lineitem").where("l_quantity > 48").select(F.col("l_partkey").alias("p_partkey"))
    return R.using_join(table(spark, folder, "part").select("p_partkey", "p_name"), many, ["p_partkey"], "left_anti")


@query("join_existence", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS dear FROM customer")
def _(spark: SparkSession, folder: str) -> DataFrame:
    dear = table(spark, folder, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return R.existence_join(table(spark, folder, "customer").select("c_custkey"), dear, ["c_custkey"], "dear")


# -- sets

_NATIONS = ("SELECT s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0")
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("except", "EXCEPT"), ("intersect", "INTERSECT")):
    sql_query(f"set_{_name}", f"({_NATIONS[0]}) {_op} ({_NATIONS[1]})")


@query("set_frame_chain", """
    ((SELECT n_regionkey AS k FROM nation) UNION (SELECT r_regionkey FROM region)) EXCEPT (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    s = session(spark, folder)
    both = s.table("nation").project_all("n_regionkey as k").union(s.table("region").project_all("r_regionkey"))
    return both.difference(s.table("supplier").filter("s_acctbal > 9000").project_all("s_nationkey")).df


_UPDATED = "SELECT c_nationkey AS k, CAST(count(*) AS INT) AS v FROM customer WHERE c_acctbal > 9500 GROUP BY c_nationkey"
sql_query("set_union_by_update", f"(SELECT n_nationkey AS k, n_regionkey AS v FROM nation) union by update k ({_UPDATED})", f"""
    WITH r AS ({_UPDATED}) SELECT * FROM r UNION ALL SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT k FROM r)
""")  # fmt: skip

# -- common table expressions and recursion

sql_query("cte_two", """
    WITH big(k, total) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey), top_(m) AS (SELECT max(total) FROM big)
    SELECT k, total FROM big, top_ WHERE total = m
""")
sql_query("recursive_bounded", """
    with recursive(4) reach(v) as (
        (SELECT CAST(0 AS BIGINT) AS v) union (SELECT (v * 7 + s_nationkey) % 101 AS v FROM reach, supplier)
    ) SELECT v FROM reach
""", """
    WITH RECURSIVE reach(v, d) AS (
        SELECT CAST(0 AS BIGINT), 0 UNION SELECT (v * 7 + s_nationkey) % 101, d + 1 FROM reach, supplier WHERE d < 4
    ) SELECT DISTINCT v FROM reach
""")  # fmt: skip
sql_query("recursive_update", """
    with recursive(3) w(k, v) as (
        (SELECT n_nationkey AS k, n_regionkey AS v FROM nation)
        union by update k
        (SELECT (k + 7) % 25 AS k, CAST((v * 3 + 1) % 1000 AS INT) AS v FROM w WHERE k % 2 = 0)
    ) SELECT k, v FROM w
""", """
    WITH w0 AS (SELECT n_nationkey AS k, n_regionkey AS v FROM nation),
    """ + ",\n    ".join(f"""
    u{i} AS (SELECT (k + 7) % 25 AS k, CAST((v * 3 + 1) % 1000 AS INT) AS v FROM w{i} WHERE k % 2 = 0),
    w{i + 1} AS (SELECT * FROM u{i} UNION ALL SELECT * FROM w{i} WHERE k NOT IN (SELECT k FROM u{i}))""" for i in range(3)) + " SELECT k, v FROM w3")  # fmt: skip


# -- functions written in Python


@query("udf_scalar", "SELECT p_partkey, (p_size * 7 + p_partkey) % 13 AS code FROM part")
def _(spark: SparkSession, folder: str) -> DataFrame:
    s = session(spark, folder)

    @F.pandas_udf("bigint")
    def code(size: pd.Series, key: pd.Series) -> pd.Series:
        return (size.astype("int64") * 7 + key) % 13

    s.functions.register("code", code)
    return s.table("part").df.select("p_partkey", s.functions.call("code", "p_size", "p_partkey").alias("code"))


class SumOfSquares(UserDefinedAggregate):
    buffer_type = result_type = "bigint"

    def initialize(self) -> int:
        return 0

    def update(self, buffer: int, values: pd.Series) -> int:
        values = values.dropna().astype("int64")
        return buffer + int((values * values).sum())

    def update_groups(self, values: pd.Series, starts: np.ndarray) -> list[int]:
        whole = values.fillna(0).astype("int64").to_numpy()
        return np.add.reduceat(whole * whole, starts).tolist()

    def merge(self, buffer: int, other: int) -> int:
        return buffer + int(other)

    def evaluate(self, buffer: int) -> int:
        return buffer


@query("udaf_sum_of_squares", "SELECT l_suppkey, CAST(sum(CAST(l_linenumber AS BIGINT) * l_linenumber) AS BIGINT) AS q FROM lineitem GROUP BY l_suppkey")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return SumOfSquares().aggregate(table(spark, folder, "lineitem"), ["l_suppkey"], "l_linenumber", "q")
