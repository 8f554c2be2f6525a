"""The entry point: SQL with the extensions, frames, catalog and functions over a Spark session."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import ClassVar

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession

from weftline import sources
from weftline.catalog import Catalog
from weftline.errors import NoSuchObject
from weftline.frame import Frame
from weftline.functions import FunctionRegistry
from weftline.operators.graph import Graph
from weftline.sqlfront import Front


class Session:
    """Never changes the Spark session's settings."""

    current: ClassVar[Session | None] = None

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog, self.functions = spark, Catalog(), FunctionRegistry()
        self.folder: str | None = None  # whose tables are registered
        Session.current = self

    @classmethod
    def of(cls, spark: SparkSession) -> Session:
        """The current session if it is of this Spark session, else a new one."""
        return cls.current if cls.current and cls.current.spark is spark else cls(spark)

    def sql(self, text: str) -> Frame:
        return Frame(self, Front(self.spark, self.catalog.get_graph).run(text))

    def table(self, name: str) -> Frame:
        if not self.spark.catalog.tableExists(name):
            raise NoSuchObject("table", name)
        return Frame(self, self.spark.table(name))

    def frame(self, df: DataFrame) -> Frame:
        return Frame(self, df)

    def from_rows(self, rows: Iterable[Sequence], schema) -> Frame:
        return Frame(self, sources.from_rows(self.spark, rows, schema))

    def from_rdd(self, rdd: RDD, schema) -> Frame:
        return Frame(self, sources.from_rdd(self.spark, rdd, schema))

    def empty(self, schema) -> Frame:
        return Frame(self, sources.empty(self.spark, schema))

    def load_tsv(self, path: str, columns: Sequence[str], **options) -> Frame:
        return Frame(self, sources.load_tsv(self.spark, path, columns, **options))

    def load_graph(self, path: str, is_undirected: bool = False) -> Graph:
        return Graph.from_edges(sources.load_graph_edges(self.spark, path, is_undirected))

    def register_tables(self, folder: str, names: Iterable[str], keys: dict[str, Sequence[str]] | None = None) -> Session:
        """Views of ``folder/name.parquet`` with their primary keys."""
        for name in names:
            self.frame(self.spark.read.parquet(f"{folder}/{name}.parquet")).create_or_replace_table(name, (keys or {}).get(name, ()))
        return self

    def register_graph(self, name: str, graph: Graph) -> Session:
        self.catalog.create_graph(name, graph, replace_it=True)
        return self

    def stop(self) -> None:
        """Ends this session; the Spark session is the caller's."""
        Session.current = None
