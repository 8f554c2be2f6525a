"""Relations made of rows at hand, and synthetic ones."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_rows(spark: SparkSession, rows: Iterable[Sequence], schema) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def from_rdd(spark: SparkSession, rdd: RDD, schema) -> DataFrame:
    return spark.createDataFrame(rdd, schema)


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def matching_relation(spark: SparkSession, columns: Sequence[str], exponents: Sequence[int], cardinality: int, filler: int = -1) -> DataFrame:
    """A relation of ``cardinality`` rows: all of ``[0, 2**e)`` for each column, then rows that match nothing.

    The filler rows hold one value each in all columns, counting on from ``filler`` away from zero.  Rows are
    computed from their number, so a relation of any size is made in parallel.
    """
    whole = reduce(lambda n, e: n << e, exponents, 1)
    if cardinality < whole:
        raise ValueError(f"{cardinality} rows can't hold the {whole} matching ones")
    shift, parts = 0, {}
    for column, e in reversed(list(zip(columns, exponents, strict=True))):
        parts[column] = F.shiftright(F.col("id"), shift).bitwiseAND(F.lit((1 << e) - 1))
        shift += e
    step = 1 if filler >= 0 else -1
    other = F.lit(filler) + (F.col("id") - whole) * step
    return spark.range(cardinality).select(*[F.when(F.col("id") < whole, parts[c]).otherwise(other).alias(c) for c in columns])
