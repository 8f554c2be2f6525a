"""Separated text files and edge lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tsv(spark: SparkSession, path: str, columns: Sequence[str], separator: str = r"\s+", kind: str = "double") -> DataFrame:
    """Lines of fields parted by the regular expression ``separator``, each read as ``kind``.

    Lines that start with ``#`` are comments.  Lines with another number of fields, or with a
    field that can't be read, are left out.
    """
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#"))
    fields = lines.select(F.split(F.trim("value"), separator).alias("f")).where(F.size("f") == len(columns))
    read = fields.select(*[F.col("f")[i].try_cast(kind).alias(c) for i, c in enumerate(columns)])
    return read.dropna(subset=list(columns))


def undirected(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Each edge in both directions, once, without self-loops."""
    kept = edges.where(F.col(src) != F.col(dst)).select(src, dst)
    return kept.unionAll(kept.select(F.col(dst).alias(src), F.col(src).alias(dst))).distinct()


def load_graph_edges(spark: SparkSession, path: str, is_undirected: bool = False, separator: str = r"\s+") -> DataFrame:
    """``(src, dst)`` of an edge list; an undirected one is read by :func:`undirected`."""
    edges = load_tsv(spark, path, ["src", "dst"], separator, "bigint")
    return undirected(edges) if is_undirected else edges


def write_tsv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, sep="\t")
