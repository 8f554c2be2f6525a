"""The registered queries of the relational and graph operators, with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.queries import graphs, relational, streams, workloads  # noqa: F401  (they register themselves)
from weftline.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_filter_group"](spark, sf_dir)
