"""A relation with set-minded operators: projections are sets, and joins without a condition are natural."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import TYPE_CHECKING

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.operators import iterate, relational
from weftline.operators.graph import EdgeMeta, Graph, NodeMeta
from weftline.plans.materialize import checkpointed

if TYPE_CHECKING:
    from weftline.session import Session


class Frame:
    """Wraps a Spark DataFrame, which is at hand as ``frame.df``; nothing runs before an action."""

    def __init__(self, session: Session, df: DataFrame):
        self.session, self.df = session, df

    def _new(self, df: DataFrame) -> Frame:
        return Frame(self.session, df)

    # -- what it is
    @property
    def schema(self) -> StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def logical(self) -> str:
        return self.df._jdf.queryExecution().logical().toString()

    def explain(self, mode: str = "extended") -> None:
        self.df.explain(mode)

    def to_spark(self) -> DataFrame:
        return self.df

    # -- actions
    def collect(self) -> list[Row]:
        return self.df.collect()

    def count(self) -> int:
        return self.df.count()

    def show(self, k: int = 20) -> None:
        self.df.show(k)

    @property
    def rdd(self) -> RDD:
        return self.df.rdd

    def cache(self) -> Frame:
        """Computed now, and read from the checkpoint folder from here on."""
        return self._new(checkpointed(self.df))

    def create_or_replace_table(self, name: str, primary_key: Sequence[str] = ()) -> Frame:
        self.session.catalog.create_or_replace_view(name, self.df)
        self.session.catalog.create_table(name, self.columns, primary_key, replace_it=True)
        return self

    # -- rows
    def filter(self, condition: str | Column) -> Frame:
        return self._new(self.df.where(condition))

    where = filter

    def select(self, condition: str | Column) -> Frame:
        """Selects rows (as in relational algebra); columns are chosen by :meth:`project`."""
        return self.filter(condition)

    def project(self, columns: str | Sequence[str]) -> Frame:
        return self._new(relational.project(self.df, columns))

    def project_all(self, columns: str | Sequence[str]) -> Frame:
        """A projection that keeps duplicates."""
        return self._new(relational.project(self.df, columns, distinct=False))

    transform = project_all

    def alias(self, names: str | Sequence[str]) -> Frame:
        return self._new(relational.rename(self.df, names))

    rename = alias

    def subquery_alias(self, name: str) -> Frame:
        return self._new(self.df.alias(name))

    def sort(self, order: str) -> Frame:
        """``"a, b desc"``; ascending unless said otherwise."""
        keys = [o.split() for o in relational.split_list(order)]
        return self._new(self.df.orderBy(*[F.col(k[0]).desc() if k[-1].lower() == "desc" else F.col(k[0]).asc() for k in keys]))

    def limit(self, k: int) -> Frame:
        return self._new(self.df.limit(k))

    def distinct(self) -> Frame:
        return self._new(self.df.distinct())

    # -- joins
    def join(self, other: Frame, condition: str | Column = "", how: str = "inner") -> Frame:
        """A natural join without a condition."""
        if isinstance(condition, str) and not condition:
            return self._new(relational.natural_join(self.df, other.df, how))
        return self.theta_join(condition, other, how)

    def natural_join(self, *others: Frame) -> Frame:
        return self._new(relational.natural_join_all([self.df, *(o.df for o in others)]))

    def using_join(self, other: Frame, keys: Sequence[str], how: str = "inner") -> Frame:
        return self._new(relational.using_join(self.df, other.df, keys, how))

    def theta_join(self, condition: str | Column, other: Frame, how: str = "inner") -> Frame:
        return self._new(relational.theta_join(self.df, other.df, condition, how))

    def cross_join(self, other: Frame) -> Frame:
        return self._new(self.df.crossJoin(other.df))

    # -- aggregates
    def aggregate(self, aggregates: str | Sequence[str], by: str | Sequence[str] = ()) -> Frame:
        """``aggregate("sum(x) as s", "a, b")``, or both in one text: ``aggregate("sum(x) as s by a, b")``."""
        if isinstance(aggregates, str) and not by and " by " in aggregates:
            aggregates, by = aggregates.rsplit(" by ", 1)
        return self._new(relational.aggregate(self.df, aggregates, by))

    # -- sets
    def union(self, *others: Frame) -> Frame:
        return self._new(relational.union(self.df, *(o.df for o in others)))

    def union_all(self, *others: Frame) -> Frame:
        return self._new(relational.union_all(self.df, *(o.df for o in others)))

    def difference(self, other: Frame) -> Frame:
        return self._new(relational.difference(self.df, other.df))

    def intersection(self, other: Frame) -> Frame:
        return self._new(relational.intersection(self.df, other.df))

    def union_by_update(self, other: Frame, keys: Sequence[str]) -> Frame:
        return self._new(relational.union_by_update(self.df, other.df, keys))

    # -- iteration
    def with_recursive(self, step: Callable[[Frame], Frame], rounds: int = iterate.MAX_ROUNDS) -> Frame:
        """``step`` applied again and again, its result taking the place of this relation."""
        return self._new(iterate.assign_rounds(self.df, lambda d: step(self._new(d)).df, rounds))

    def update_until_fixed(
        self, delta: Frame, step: Callable[[Frame], Frame], keys: Sequence[str], value: str, best: str = "min", rounds: int = iterate.MAX_ROUNDS
    ) -> Frame:
        """This relation with better values merged in until none is found."""
        return self._new(iterate.fixpoint(self.df, delta.df, lambda d: step(self._new(d)).df, keys, value, best, rounds))

    # -- graphs
    def to_graph(self, edge: EdgeMeta = EdgeMeta()) -> Graph:
        return Graph.from_edges(self.df, edge)

    def to_graph_with(self, nodes: Frame, node: NodeMeta = NodeMeta(), edge: EdgeMeta = EdgeMeta()) -> Graph:
        return Graph(nodes.df, self.df, node, edge)
