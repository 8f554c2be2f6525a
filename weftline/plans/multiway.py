"""Natural joins of many relations, and sums over them without building the join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import natural_join
from weftline.plans import hypergraph


@dataclass(frozen=True)
class Relation:
    """A relation of attributes; each row counts ``weight`` (a column beside the attributes) or 1."""

    frame: DataFrame
    attributes: tuple[str, ...]
    weight: str | None = None


def joined(relations: Sequence[DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """The natural join of all, in an order that closes cycles early; columns in order of first appearance."""
    names = columns or list(dict.fromkeys(c for r in relations for c in r.columns))
    order = hypergraph.join_order(hypergraph.edges_of(r.columns for r in relations))
    out = relations[order[0]]
    for i in order[1:]:
        out = natural_join(out, relations[i])
    return out.select(*names)


def _factor(relation: Relation) -> DataFrame:
    weight = F.col(relation.weight) if relation.weight else F.lit(1).cast("long")
    return relation.frame.select(*relation.attributes, weight.alias("_n"))


def _product(factors: Sequence[DataFrame]) -> DataFrame:
    """The natural join of factors, their ``_n`` multiplied."""
    attributes = [[c for c in f.columns if c != "_n"] for f in factors]
    order = hypergraph.join_order(hypergraph.edges_of(attributes))
    out = None
    for k in order:
        factor = factors[k].withColumnRenamed("_n", f"_n{k}")
        out = factor if out is None else natural_join(out, factor)
    names = list(dict.fromkeys(c for a in attributes for c in a))
    total = F.col("_n0")
    for k in range(1, len(factors)):
        total = total * F.col(f"_n{k}")
    return out.select(*names, total.alias("_n"))


def sum_product(relations: Sequence[Relation], by: Sequence[str], name: str = "total") -> DataFrame:
    """``by`` and the sum, over the natural join of all relations, of the product of the weights.

    With all weights 1 it is ``count(*) ... group by by``; with one weight w it is ``sum(w)``.  Attributes are summed out one
    after another, so partial sums, not joined tuples, go from step to step: for each
    attribute the relations (and partial sums) that hold it are joined with all that lie within the same
    attributes, and grouped by what remains.
    """
    factors = [_factor(r) for r in relations]
    held = [frozenset(r.attributes) for r in relations]
    for v in hypergraph.elimination_order(held, by):
        bag = frozenset().union(*[h for h in held if v in h])
        inside = [i for i, h in enumerate(held) if h <= bag]
        part = _product([factors[i] for i in inside])
        if len(inside) == len(factors):  # all that is left: one grouping does for all remaining attributes
            factors = [part]
            break
        rest = sorted(bag - {v})
        part = part.groupBy(*rest).agg(F.sum("_n").alias("_n")) if rest else part.agg(F.sum("_n").alias("_n"))
        # First, as orders of equal estimate go by place: a partial sum, say of a closed cycle, is likely to be small.
        factors = [part] + [f for i, f in enumerate(factors) if i not in inside]
        held = [frozenset(rest)] + [h for i, h in enumerate(held) if i not in inside]
    out = _product(factors)
    return (out.groupBy(*by) if by else out.groupBy()).agg(F.sum("_n").alias(name))


def count_by(relations: Mapping[str, DataFrame] | Sequence[DataFrame], by: Sequence[str], name: str = "n") -> DataFrame:
    """``count(*)`` of the natural join, for each value of ``by``."""
    frames = list(relations.values()) if isinstance(relations, Mapping) else list(relations)
    return sum_product([Relation(f, tuple(f.columns)) for f in frames], by, name)


def distinct_pairs_then_count(relations: Sequence[DataFrame], keep: Sequence[str], by: str, name: str = "n") -> DataFrame:
    """``count(*) by by`` over the **distinct** projection of the join to ``keep``.

    The other attributes are summed out first, so the distinct rows come from partial sums.
    """
    return count_by(relations, keep, "_n").groupBy(by).agg(F.count(F.lit(1)).alias(name))


def key_first_order(relations: Mapping[str, Sequence[str]], keys: Mapping[str, Sequence[str]]) -> list[str]:
    """An order of natural joins for relations with primary keys: each next one is joined on its whole key if
    possible (which adds no rows), then on any common column; names decide ties.

    It starts where the fewest joins are on other columns, and those come last.
    """

    def on_key(r: str, bound: set[str]) -> bool:
        return bool(keys.get(r)) and set(keys[r]) <= bound

    def from_start(first: str) -> tuple[list[bool], list[str]]:
        order, bound, adds = [first], set(relations[first]), []
        while left := [r for r in relations if r not in order]:
            order.append(min(left, key=lambda r: (not on_key(r, bound), not set(relations[r]) & bound, r)))
            adds.append(not on_key(order[-1], bound))
            bound |= set(relations[order[-1]])
        return adds, order

    found = {r: from_start(r) for r in relations}
    best = min(relations, key=lambda r: (sum(found[r][0]), found[r][0], r in keys, r))
    return found[best][1]
