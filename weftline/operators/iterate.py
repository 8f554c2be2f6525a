"""Iteration: loops on the driver over plans that run on the executors.

Only counts of changed rows come back to the driver.  The state is checkpointed every round, so plans stay
short and a lost executor costs no more than the round.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.relational import union_by_update
from weftline.plans.materialize import checkpointed

#: Rounds after which a loop ends if it hasn't settled.
MAX_ROUNDS = 20

Step = Callable[[DataFrame], DataFrame]


def assign_rounds(state: DataFrame, step: Step, rounds: int = MAX_ROUNDS) -> DataFrame:
    """``step`` applied ``rounds`` times, each result taking the place of the state."""
    for k in range(rounds):
        state = step(state)
        if k + 1 < rounds:
            state = checkpointed(state)
    return state


def monotone_update(state: DataFrame, new: DataFrame, keys: Sequence[str], value: str, best: str = "min") -> tuple[DataFrame, DataFrame]:
    """The state with new and better values taken over, and those rows alone.

    ``new`` holds one row for each key.  Better is smaller for ``min`` and greater for ``max``.
    """
    pick = {"min": F.least, "max": F.greatest}[best]
    both = state.select(*keys, F.col(value).alias("_old")).join(new.select(*keys, F.col(value).alias("_new")), list(keys), "full")
    both = checkpointed(both.select(*keys, pick("_old", "_new").alias(value), (~F.col("_old").eqNullSafe(pick("_old", "_new"))).alias("_changed")))
    return both.select(*keys, value), both.where("_changed").select(*keys, value)


def fixpoint(
    state: DataFrame, delta: DataFrame, step: Step, keys: Sequence[str], value: str, best: str = "min", max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """Repeat: ``step`` of the rows that changed last, merged into the state; until none changes or the rounds are used.

    ``step`` gives at most one row for each key.
    """
    for _ in range(max_rounds):
        state, delta = monotone_update(state, step(delta), keys, value, best)
        if delta.isEmpty():
            break
    return state


def recursive_union(base: DataFrame, step: Step, max_rounds: int = MAX_ROUNDS, distinct: bool = True) -> DataFrame:
    """``WITH RECURSIVE``: ``base`` and all that ``step`` derives from the rows of the round before.

    With ``distinct`` only rows that are new count, so the loop ends by itself on finite results.
    """
    total = delta = checkpointed(base.distinct() if distinct else base)
    for _ in range(max_rounds):
        found = step(delta).toDF(*base.columns)
        delta = checkpointed(found.distinct().subtract(total) if distinct else found)
        if delta.isEmpty():
            break
        total = total.unionAll(delta)
        if distinct:
            total = checkpointed(total)
    return total


def recursive_update(base: DataFrame, step: Step, keys: Sequence[str], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``UNION BY UPDATE`` in a recursion: each round's rows replace those with their keys; ends when nothing changes."""
    state = checkpointed(base)
    for _ in range(max_rounds):
        new = checkpointed(union_by_update(state, step(state), keys))
        if new.exceptAll(state).isEmpty():
            return new
        state = new
    return state
