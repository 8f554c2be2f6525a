"""Property graphs as two relations, with subgraphs, pattern matching and message passing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from weftline.errors import WeftlineError
from weftline.operators import pattern as patterns
from weftline.operators.relational import natural_join
from weftline.plans import hypergraph
from weftline.plans.materialize import checkpointed


@dataclass(frozen=True)
class NodeMeta:
    id: str = "id"
    label: str | None = None


@dataclass(frozen=True)
class EdgeMeta:
    src: str = "src"
    dst: str = "dst"
    label: str | None = None


def _described(frame: DataFrame, element: patterns.Element, label: str | None) -> DataFrame:
    """Rows with the element's labels and properties.

    A label column of arrays must hold all the labels; one of single values must be one of them.
    """
    out = frame
    if element.labels:
        if label is None:
            raise WeftlineError(f"labels {element.labels} in the pattern, but the graph has no label column")
        if isinstance(frame.schema[label].dataType, ArrayType):
            for value in element.labels:
                out = out.where(F.array_contains(label, value))
        else:
            out = out.where(F.col(label).cast("string").isin(*element.labels))
    for key, value in element.properties:
        out = out.where(F.col(key) == F.lit(value))
    return out


class Graph:
    """Nodes and directed edges; columns beside ids and labels are properties."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, node: NodeMeta = NodeMeta(), edge: EdgeMeta = EdgeMeta()):
        self._nodes, self._edges, self.node_meta, self.edge_meta = nodes, edges, node, edge

    @classmethod
    def from_edges(cls, edges: DataFrame, edge: EdgeMeta = EdgeMeta()) -> Graph:
        """The nodes are the ends of the edges, each once."""
        ends = edges.select(F.col(edge.src).alias("id")).unionAll(edges.select(F.col(edge.dst).alias("id")))
        return cls(ends.distinct(), edges, NodeMeta(), edge)

    @classmethod
    def from_nodes(cls, nodes: DataFrame, node: NodeMeta = NodeMeta()) -> Graph:
        return cls(nodes, nodes.sparkSession.createDataFrame([], "src long, dst long"), node, EdgeMeta())

    def node(self) -> DataFrame:
        return self._nodes

    def edge(self) -> DataFrame:
        return self._edges

    def relation(self) -> DataFrame:
        """Edge columns with the properties of both ends, as ``src_*`` and ``dst_*``."""
        n, e = self.node_meta, self.edge_meta
        out = self._edges
        for end, key in (("src", e.src), ("dst", e.dst)):
            side = self._nodes.select(F.col(n.id).alias(key), *[F.col(c).alias(f"{end}_{c}") for c in self._nodes.columns if c != n.id])
            out = out.join(side, key)
        return out.select(*self._edges.columns, *[c for c in out.columns if c not in self._edges.columns])

    def subgraph(self, node_filter: str | Column | None = None, edge_filter: str | Column | None = None) -> Graph:
        """The nodes and edges that meet the filters, without edges of which an end is gone."""
        nodes = self._nodes if node_filter is None else self._nodes.where(node_filter)
        edges = self._edges if edge_filter is None else self._edges.where(edge_filter)
        if node_filter is not None:
            ids = nodes.select(self.node_meta.id).distinct()
            for key in (self.edge_meta.src, self.edge_meta.dst):
                edges = edges.join(ids.withColumnRenamed(self.node_meta.id, key), key, "left_semi").select(*edges.columns)
        return Graph(nodes, edges, self.node_meta, self.edge_meta)

    def reverse(self) -> Graph:
        e = self.edge_meta
        turned = self._edges.select(*[F.col({e.src: e.dst, e.dst: e.src}.get(c, c)).alias(c) for c in self._edges.columns])
        return Graph(self._nodes, turned, self.node_meta, e)

    def degrees(self, end: str = "dst") -> DataFrame:
        """``(end, degree)`` for the nodes with edges at that end."""
        key = self.edge_meta.dst if end == "dst" else self.edge_meta.src
        return self._edges.groupBy(F.col(key).alias(end)).agg(F.count(F.lit(1)).alias("degree"))

    def pattern(self, text: str, properties: bool = False) -> DataFrame:
        """All matches of a pattern, as a bag: each name of a node a column of ids.

        Matches are homomorphisms: different names may stand for one node.  An edge without direction counts in
        both.  With ``properties``, named nodes and edges bring theirs along as ``name_property``.
        Paths that share no node are combined in all ways.
        """
        parsed = patterns.parse(text)
        n, e = self.node_meta, self.edge_meta
        column = [x.name or f"_node{k}" for k, x in enumerate(parsed.nodes)]
        used: set[int] = set()
        relations: list[DataFrame] = []
        extra: list[str] = []

        def named(frame: DataFrame, element: patterns.Element, skip: set[str]) -> list[Column]:
            if not (properties and element.name):
                return []
            names = [c for c in frame.columns if c not in skip]
            extra.extend(f"{element.name}_{c}" for c in names)
            return [F.col(c).alias(f"{element.name}_{c}") for c in names]

        described = {
            k: _described(self._nodes, x, n.label).select(n.id).distinct() for k, x in enumerate(parsed.nodes) if x.labels or x.properties
        }
        for step in parsed.steps:
            kept = _described(self._edges, step.edge, e.label)
            more = named(kept, step.edge, {e.src, e.dst})
            ways = {"out": [(e.src, e.dst)], "in": [(e.dst, e.src)], "both": [(e.src, e.dst), (e.dst, e.src)]}[step.direction]
            left, right = column[step.left], column[step.right]
            if step.left == step.right:
                kept, ways = kept.where(F.col(e.src) == F.col(e.dst)), ways[:1]
            sides = [
                kept.select(*([F.col(a).alias(left)] if left == right else [F.col(a).alias(left), F.col(b).alias(right)]), *more)
                for a, b in ways
            ]
            out = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
            for k in {step.left, step.right}:
                if k in described:
                    out = out.join(described[k].withColumnRenamed(n.id, column[k]), column[k], "left_semi").select(*out.columns)
                used.add(k)
            relations.append(out)
        for k, x in enumerate(parsed.nodes):
            if k not in used or (properties and x.name):
                mine = _described(self._nodes, x, n.label)
                relations.append(mine.select(F.col(n.id).alias(column[k]), *named(mine, x, {n.id})))
        ids = [set(r.columns) & set(column) for r in relations]
        out = None
        for i in hypergraph.join_order(hypergraph.edges_of(ids)):
            out = relations[i] if out is None else natural_join(out, relations[i])
        return out.select(*[c for c, x in zip(column, parsed.nodes, strict=True) if x.name], *extra)

    def message_passing(
        self, message: str, merge: str, update: str = "new_state", initial: str = "1.0", rounds: int = 1, keep_silent: bool = True
    ) -> DataFrame:
        """``(id, state)`` after ``rounds`` rounds.

        In each round every edge sends ``message``, an expression over the sender's ``state`` and the columns of edge and
        sender, to its ``dst``; ``merge`` is an aggregate over the arriving ``new_state``; ``update`` combines ``state`` and
        ``new_state``.  ``initial`` is over the node's columns.  A node without messages keeps its state, or, if not
        ``keep_silent``, is updated with a NULL ``new_state``.
        """
        if rounds < 1:
            raise ValueError("rounds must be 1 or more")
        n, e = self.node_meta, self.edge_meta
        state = self._nodes.select(F.col(n.id).alias("id"), F.expr(initial).alias("state"))
        sender = self._nodes.withColumnRenamed(n.id, "_id")
        needs_nodes = len(self._nodes.columns) > 1
        for k in range(rounds):
            sent = self._edges.join(state.select(F.col("id").alias("_from"), "state"), F.col(e.src) == F.col("_from"))
            if needs_nodes:
                sent = sent.join(sender, F.col(e.src) == F.col("_id"))
            merged = sent.select(F.col(e.dst).alias("id"), F.expr(message).alias("new_state")).groupBy("id").agg(F.expr(merge).alias("new_state"))
            new = F.expr(update)
            if keep_silent:
                new = F.when(F.col("new_state").isNull(), F.col("state")).otherwise(new)
            state = state.join(merged, "id", "left").select("id", new.alias("state"))
            if (k + 1) % 5 == 0 and k + 1 < rounds:
                state = checkpointed(state)
        return state
