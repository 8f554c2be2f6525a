"""Counting the partners of an inequality join without building it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stretches of the value range that are summed apart.
STRETCHES = 1024


def count_less(left: DataFrame, a: str, right: DataFrame, b: str, name: str = "n") -> DataFrame:
    """``right`` with the number of rows of ``left`` whose ``a`` is less than ``b``; NULLs match nothing.

    What a nested loop finds in |left| * |right| steps is a running sum here: equal values are counted first, sums of
    equal stretches of the value range are carried forward, and values are sorted within their stretch only.
    """
    counts = left.where(F.col(a).isNotNull()).groupBy(F.col(a).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    asked = right.where(F.col(b).isNotNull()).select(F.col(b).alias("x")).distinct()
    rows = counts.select("x", "c", F.lit(1).alias("own")).unionAll(asked.select("x", F.lit(0).cast("long").alias("c"), F.lit(0).alias("own")))
    # Values keep their type; as doubles, which may be coarser but keep the order, they only choose the stretch.
    x = F.col("x").cast("double")
    ends = rows.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, width = ends["lo"] or 0.0, ((ends["hi"] or 0.0) - (ends["lo"] or 0.0)) / STRETCHES or 1.0
    rows = rows.withColumn("stretch", F.floor((x - lo) / width))
    # A value asked for comes before an equal value that is counted.
    within = F.sum("c").over(Window.partitionBy("stretch").orderBy("x", "own").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    sums = rows.groupBy("stretch").agg(F.sum("c").alias("t")).select("stretch", F.coalesce(before, F.lit(0)).alias("earlier"))
    found = rows.withColumn("within", within).where("own = 0").join(sums, "stretch").select("x", (F.col("within") + F.col("earlier")).alias("_n"))
    out = right.join(found, F.col(b) == F.col("x"), "left")
    return out.select(*[right[c] for c in right.columns], F.coalesce("_n", F.lit(0)).alias(name))
