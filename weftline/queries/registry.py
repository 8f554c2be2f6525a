"""How a query is registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.session import Session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

TABLES = "region nation customer supplier part orders lineitem events".split()
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"],
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function of (spark, folder) under ``name`` with the SQL that gives the same rows."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is text for the session's SQL front; ``oracle`` where DuckDB needs another text."""
    query(name, oracle or text)(lambda spark, folder: session(spark, folder).sql(text).df)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def session(spark: SparkSession, folder: str) -> Session:
    """A session with views of the tables of ``folder``; asked for the same folder again, they are there."""
    found = Session.of(spark)
    if found.folder != folder:
        found.register_tables(folder, TABLES, KEYS).folder = folder
    return found
