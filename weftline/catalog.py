"""What the session knows by name: databases, tables with keys, graphs, views."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from weftline.errors import AlreadyExists, NoSuchObject
from weftline.operators.graph import Graph


@dataclass(frozen=True)
class TableEntry:
    name: str
    columns: tuple[str, ...]
    primary_key: tuple[str, ...] = ()


@dataclass
class Database:
    name: str
    comment: str = ""
    tables: dict[str, TableEntry] = field(default_factory=dict)


class Catalog:
    """In-memory metadata.  Rows stay with Spark: tables and views are Spark's temporary views."""

    def __init__(self) -> None:
        self._databases: dict[str, Database] = {"default": Database("default")}
        self._graphs: dict[str, Graph] = {}
        self._views: dict[str, DataFrame] = {}
        self.current = "default"

    # -- databases
    def create_database(self, name: str, comment: str = "", ignore_if_exists: bool = False) -> None:
        if name in self._databases:
            if ignore_if_exists:
                return
            raise AlreadyExists("database", name)
        self._databases[name] = Database(name, comment)

    def get_database(self, name: str) -> Database:
        if name not in self._databases:
            raise NoSuchObject("database", name)
        return self._databases[name]

    def alter_database(self, name: str, comment: str) -> None:
        self.get_database(name).comment = comment

    def drop_database(self, name: str, ignore_if_missing: bool = False) -> None:
        if self._databases.pop(name, None) is None and not ignore_if_missing:
            raise NoSuchObject("database", name)

    def list_databases(self) -> list[str]:
        return sorted(self._databases)

    # -- tables
    def _tables(self, database: str | None) -> dict[str, TableEntry]:
        return self.get_database(database or self.current).tables

    def create_table(self, name: str, columns: Sequence[str], primary_key: Sequence[str] = (), replace_it: bool = False, database: str | None = None) -> TableEntry:
        tables = self._tables(database)
        if name in tables and not replace_it:
            raise AlreadyExists("table", name)
        tables[name] = TableEntry(name, tuple(columns), tuple(primary_key))
        return tables[name]

    def get_table(self, name: str, database: str | None = None) -> TableEntry:
        tables = self._tables(database)
        if name not in tables:
            raise NoSuchObject("table", name)
        return tables[name]

    def alter_table(self, name: str, database: str | None = None, **changes) -> TableEntry:
        entry = replace(self.get_table(name, database), **changes)
        self._tables(database)[name] = entry
        return entry

    def drop_table(self, name: str, ignore_if_missing: bool = False, database: str | None = None) -> None:
        if self._tables(database).pop(name, None) is None and not ignore_if_missing:
            raise NoSuchObject("table", name)

    def list_tables(self, database: str | None = None) -> list[str]:
        return sorted(self._tables(database))

    def primary_keys(self, database: str | None = None) -> dict[str, tuple[str, ...]]:
        return {t.name: t.primary_key for t in self._tables(database).values() if t.primary_key}

    # -- graphs
    def create_graph(self, name: str, graph: Graph, replace_it: bool = False) -> None:
        if name in self._graphs and not replace_it:
            raise AlreadyExists("graph", name)
        self._graphs[name] = graph

    def get_graph(self, name: str) -> Graph:
        if name not in self._graphs:
            raise NoSuchObject("graph", name)
        return self._graphs[name]

    def alter_graph(self, name: str, graph: Graph) -> None:
        self.get_graph(name)
        self._graphs[name] = graph

    def drop_graph(self, name: str, ignore_if_missing: bool = False) -> None:
        if self._graphs.pop(name, None) is None and not ignore_if_missing:
            raise NoSuchObject("graph", name)

    def list_graphs(self) -> list[str]:
        return sorted(self._graphs)

    # -- views
    def register_view(self, name: str, frame: DataFrame) -> None:
        if name in self._views:
            raise AlreadyExists("view", name)
        self.create_or_replace_view(name, frame)

    def create_or_replace_view(self, name: str, frame: DataFrame) -> None:
        frame.createOrReplaceTempView(name)
        self._views[name] = frame

    def get_view(self, name: str) -> DataFrame:
        if name not in self._views:
            raise NoSuchObject("view", name)
        return self._views[name]

    def drop_view(self, name: str) -> bool:
        """Whether there was such a view."""
        frame = self._views.pop(name, None)
        return frame is not None and frame.sparkSession.catalog.dropTempView(name)

    def list_views(self) -> list[str]:
        return sorted(self._views)
