"""One-round multiway joins: a hypercube shuffle, then a worst-case-optimal join in each cell.

An alternative to join trees for cyclic queries whose intermediate results dwarf inputs and result.  The
shares of the attributes are chosen so that the rows received by a cell are fewest and fit a budget.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.materialize import stored

#: Rows that a cell may receive before more cells are used.
CELL_ROWS = 4_000_000
#: Candidates that a cell's join makes at once.
PART_ROWS = 1 << 20


def load(relations: Sequence[tuple[frozenset[str], float]], shares: Mapping[str, int]) -> float:
    """Rows that a cell receives: each relation is cut by its own attributes and copied along the others."""
    cells = prod(shares.values())
    return sum(rows * prod(s for a, s in shares.items() if a not in attributes) / cells for attributes, rows in relations)


def optimal_shares(
    relations: Sequence[tuple[Sequence[str], float]],
    tasks: int,
    fixed: Mapping[str, int] | None = None,
    budget: float = CELL_ROWS,
    limit: int = 1 << 16,
) -> dict[str, int]:
    """Whole shares with at most ``tasks`` cells and the least load; ties to the smaller sum of shares.

    ``fixed`` shares are kept.  While the load is above ``budget``, twice the tasks are tried, up to ``limit``.
    """
    fixed = dict(fixed or {})
    held = [(frozenset(a), float(n)) for a, n in relations]
    free = sorted(set().union(*(a for a, _ in held)) - set(fixed))

    def vectors(names: Sequence[str], room: int) -> Iterator[dict[str, int]]:
        if not names:
            yield {}
            return
        for s in range(1, room + 1):
            for rest in vectors(names[1:], room // s):
                yield {names[0]: s, **rest}

    while True:
        room = max(1, tasks // prod(fixed.values()))
        best = min(vectors(free, room), key=lambda v: (load(held, {**fixed, **v}), sum(v.values()), sorted(v.items())))
        if load(held, {**fixed, **best}) <= budget or tasks * 2 > limit:
            return {**fixed, **best}
        tasks *= 2


def cell(values: Mapping[str, Column], shares: Mapping[str, int]) -> Column:
    """The number of the cell at the coordinates that the values hash to (mixed radix, in order of the names)."""
    out, factor = F.lit(0), 1
    for a in sorted(shares):
        out = out + values[a] * factor
        factor *= shares[a]
    return out


def coordinate(value: Column, share: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(share)).cast("int")


def dealt(frame: DataFrame, attributes: Sequence[str], shares: Mapping[str, int]) -> DataFrame:
    """Each row once for every cell that may need it, in ``_cell``."""
    out, values = frame, {}
    for a in sorted(shares):
        if a in attributes:
            values[a] = coordinate(F.col(a), shares[a])
        else:
            out = out.withColumn(f"_c_{a}", F.explode(F.sequence(F.lit(0), F.lit(shares[a] - 1)))) if shares[a] > 1 else out
            values[a] = F.col(f"_c_{a}") if shares[a] > 1 else F.lit(0)
    return out.withColumn("_cell", cell(values, shares)).select("_cell", *frame.columns)


def _trie(rows: np.ndarray, span: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The levels of sorted distinct rows of values below ``span``: keys ``parent * span + value``, and where each parent's begin."""
    levels, parent, parents = [], np.zeros(len(rows), np.int64), 1
    for c in range(rows.shape[1]):
        own = parent * span + rows[:, c]
        new = np.diff(own, prepend=-1) != 0
        keys = own[new]
        levels.append((keys, np.searchsorted(keys, np.arange(parents + 1) * span)))
        parent, parents = np.cumsum(new) - 1, len(keys)
    return levels


def leapfrog_parts(
    relations: Sequence[tuple[Sequence[str], np.ndarray, np.ndarray]], order: Sequence[str], most: int = PART_ROWS
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The natural join of relations, attribute by attribute, and each result's multiplicity, in parts.

    A relation is its attributes, its distinct rows and their multiplicities.  At each attribute every prefix is extended by the
    values of the relation that holds the fewest under it, which are then looked up in the others.  All prefixes of a part are
    worked on at once; a part makes ``most`` candidates at most, or as many as one prefix has.
    """
    held = [rows for _, rows, _ in relations if len(rows)]
    if len(held) < len(relations):
        return
    low, high = min(int(r.min()) for r in held), max(int(r.max()) for r in held)
    span, codes = high - low + 1, None
    if span * (max(map(len, held)) + 1) >= 1 << 62:  # keys must be whole numbers of 64 bits: values by their rank
        codes = np.unique(np.concatenate([r.ravel() for r in held]))
        span = len(codes)
    tries, many, at_depth = [], [], [[] for _ in order]
    for k, (attributes, rows, counts) in enumerate(relations):
        names = [a for a in order if a in attributes]
        rows = rows[:, [list(attributes).index(a) for a in names]]
        rows = rows - low if codes is None else np.searchsorted(codes, rows)
        by = np.lexsort(rows.T[::-1])
        tries.append(_trie(rows[by], span))
        many.append(counts[by])
        for c, a in enumerate(names):
            at_depth[list(order).index(a)].append((k, c))

    def extended(depth: int, prefix: np.ndarray, nodes: np.ndarray, k: int, c: int, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, begin = tries[k][c]
        of = np.repeat(np.arange(len(sizes)), sizes)
        found = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[nodes[k]][of]
        value, looked = keys[found] % span, {k: found}
        for j, d in at_depth[depth]:
            if j == k:
                continue
            others = tries[j][d][0]
            key = nodes[j][of] * span + value
            place = np.minimum(np.searchsorted(others, key), len(others) - 1)
            kept = np.flatnonzero(others[place] == key)
            of, value, looked = of[kept], value[kept], {i: p[kept] for i, p in looked.items()} | {j: place[kept]}
        after = nodes[:, of]
        for j, p in looked.items():
            after[j] = p
        return np.vstack([prefix[:, of], value[None]]), after

    def search(depth: int, prefix: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if depth == len(order):
            out = np.ones(prefix.shape[1], np.int64)
            for k, counts in enumerate(many):
                out *= counts[nodes[k]]
            yield (prefix.T + low if codes is None else codes[prefix.T]), out
            return
        here = at_depth[depth]
        sizes = np.array([tries[k][c][1][nodes[k] + 1] - tries[k][c][1][nodes[k]] for k, c in here])
        which, least = sizes.argmin(0), sizes.min(0)
        for n, (k, c) in enumerate(here):
            mine = np.flatnonzero((which == n) & (least > 0))
            total = np.cumsum(least[mine])
            start = 0
            while start < len(mine):
                done = total[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(total, done + most, "right")))
                part = mine[start:end]
                longer, after = extended(depth, prefix[:, part], nodes[:, part], k, c, least[part])
                if longer.shape[1]:
                    yield from search(depth + 1, longer, after)
                start = end

    yield from search(0, np.zeros((0, 1), np.int64), np.zeros((len(relations), 1), np.int64))


def leapfrog(relations: Sequence[tuple[Sequence[str], np.ndarray, np.ndarray]], order: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All parts of :func:`leapfrog_parts` together."""
    parts = list(leapfrog_parts(relations, order)) or [(np.zeros((0, len(order)), np.int64), np.zeros(0, np.int64))]
    return np.concatenate([p for p, _ in parts]), np.concatenate([n for _, n in parts])


def hypercube_join(relations: Sequence[DataFrame], tasks: int | None = None, order: Sequence[str] | None = None, budget: float = CELL_ROWS) -> DataFrame:
    """The natural join (a bag) of relations of whole numbers without NULLs among the joined rows.

    Rows with a NULL in any attribute join nothing and are left out.  A value that holds a large part of a relation
    fills its cells unevenly, which a join tree with adaptive skew handling does not; prefer
    :func:`weftline.plans.multiway.joined` unless intermediate results are the problem.
    """
    spark = relations[0].sparkSession
    names = list(order or dict.fromkeys(c for r in relations for c in r.columns))
    # Stored, as they are read twice: counted and dealt.
    counted = [stored(r.dropna().groupBy(*r.columns).agg(F.count(F.lit(1)).alias("_n"))) for r in relations]
    sizes = [(tuple(r.columns), float(c.count())) for r, c in zip(relations, counted, strict=True)]
    shares = optimal_shares(sizes, tasks or spark.sparkContext.defaultParallelism, budget=budget)
    most = max(len(r.columns) for r in relations)

    def flat(k: int, r: DataFrame) -> list[Column]:
        values = [F.col(a).cast("long") for a in r.columns] + [F.lit(0).cast("long")] * (most - len(r.columns))
        return [F.lit(k).alias("_r"), *[v.alias(f"_v{i}") for i, v in enumerate(values)]]

    rows = [dealt(c, r.columns, shares).select("_cell", *flat(k, r), "_n") for k, (r, c) in enumerate(zip(relations, counted, strict=True))]
    attributes = [tuple(r.columns) for r in relations]

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        inputs = []
        for k, a in enumerate(attributes):
            own = pdf[pdf["_r"] == k]
            inputs.append((a, own[[f"_v{i}" for i in range(len(a))]].to_numpy(np.int64), own["_n"].to_numpy(np.int64)))
        found, many = leapfrog(inputs, names)
        out = pd.DataFrame(found, columns=names)
        out["_n"] = many
        return out

    schema = ", ".join([*(f"`{n}` long" for n in names), "_n long"])
    out = reduce(DataFrame.unionAll, rows).groupBy("_cell").applyInPandas(join, schema)
    return out.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*names)
