"""Row, join, set and aggregate operators that differ from, or aren't in, the DataFrame API."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.errors import WeftlineError


def split_list(text: str) -> list[str]:
    """The items of a list parted by commas that aren't within brackets or quotes."""
    items, depth, quote, start = [], 0, "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
        elif ch == "," and not depth:
            items.append(text[start:i].strip())
            start = i + 1
    return [x for x in [*items, text[start:].strip()] if x]


def project(df: DataFrame, columns: str | Sequence[str], distinct: bool = True) -> DataFrame:
    """The given expressions; as a set unless ``distinct`` is false."""
    chosen = df.selectExpr(*(split_list(columns) if isinstance(columns, str) else columns))
    return chosen.distinct() if distinct else chosen


def aggregate(df: DataFrame, aggregates: str | Sequence[str], by: str | Sequence[str] = ()) -> DataFrame:
    """Grouping columns, then the aggregates (``"sum(x) as s, count(*) as n"``)."""
    given = split_list(aggregates) if isinstance(aggregates, str) else aggregates
    keys = split_list(by) if isinstance(by, str) else list(by)
    calls = [F.expr(re.sub(r"\baverage\s*\(", "avg(", a, flags=re.I)) for a in given]
    return df.groupBy(*keys).agg(*calls) if keys else df.agg(*calls)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    return [c for c in left.columns if c in right.columns]


def using_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equality on ``keys``: the keys once (of both sides for an outer join), then the other columns of each side."""
    if missing := [k for k in keys if k not in left.columns or k not in right.columns]:
        raise WeftlineError(f"{missing} not found on both sides of the join")
    # With names to join on, Spark puts the columns in that order itself.
    return left.join(right, list(keys), how)


def natural_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Equality on all common columns; without any, every pair of rows."""
    keys = common_columns(left, right)
    return using_join(left, right, keys, how) if keys else left.crossJoin(right)


def natural_join_all(relations: Sequence[DataFrame]) -> DataFrame:
    return reduce(natural_join, relations)


def theta_join(left: DataFrame, right: DataFrame, condition: str | Column, how: str = "inner") -> DataFrame:
    """Rows that meet any condition over both sides.  Without an equality Spark runs it as a nested loop."""
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, how)


def dealt_out(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """The rows in ``tasks`` parts (four for each core if not given), for a step that makes many rows of each.

    A small file is read by one task, which would make all of them.
    """
    return df.repartition(tasks or 4 * df.sparkSession.sparkContext.defaultParallelism)


def pairs_join(many: DataFrame, few: DataFrame, condition: str | Column | None = None, most: int = 1_000_000) -> DataFrame:
    """An inner join whose result dwarfs both sides, on a condition or else the common columns.

    ``few`` is sent to all tasks if it has ``most`` rows or fewer, and the rows of ``many`` are dealt out, so no pair is shuffled,
    whatever value it has.  Beyond that Spark pairs blocks of both sides, or sorts both and splits large groups.
    """
    if few.limit(most + 1).count() <= most:
        few = F.broadcast(few)
    many = dealt_out(many)
    return natural_join(many, few) if condition is None else theta_join(many, few, condition)


def existence_join(left: DataFrame, right: DataFrame, keys: Sequence[str], name: str = "exists") -> DataFrame:
    """``left`` with a column that tells whether a partner exists; one row for each row of ``left``."""
    found = right.select(*keys).distinct().withColumn("_there", F.lit(True))
    return left.join(found, list(keys), "left").select(*[left[c] for c in left.columns], F.col("_there").isNotNull().alias(name))


def small_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", most: int = 100_000) -> DataFrame:
    """A join for which ``right`` is sent to all tasks if it has ``most`` rows or fewer; else an ordinary one."""
    few = right.limit(most + 1).count() <= most
    return using_join(left, F.broadcast(right) if few else right, keys, how)


def union_all(*frames: DataFrame) -> DataFrame:
    """Positional, with the first one's names; keeps duplicates."""
    return reduce(DataFrame.unionAll, frames)


def union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def intersection(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def union_by_update(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``right``'s rows, and those of ``left`` whose key isn't in ``right``.

    ``right`` must be unique by key; columns are matched by place and keep ``left``'s names.
    """
    new = right.toDF(*left.columns)
    return left.join(new.select(*keys), list(keys), "left_anti").select(*left.columns).unionAll(new)


def rename(df: DataFrame, names: str | Sequence[str]) -> DataFrame:
    """New names for all columns, in order."""
    return df.toDF(*(split_list(names) if isinstance(names, str) else names))


def transform(df: DataFrame, expressions: str | Sequence[str]) -> DataFrame:
    """A row of expressions for each row."""
    return project(df, expressions, distinct=False)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The first ``k`` rows by the order, found by partial sorts in each task."""
    return df.orderBy(*order).limit(k)
