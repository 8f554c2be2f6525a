"""Streams of changes: upserts into a stored relation, and windowed counts with a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators.relational import union_by_update


def latest_by_key(changes: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row for each key: that with the greatest ``order`` (then the greatest other columns)."""
    rest = [c for c in changes.columns if c not in keys]
    row = F.max(F.struct(order, *[c for c in rest if c != order])).alias("_row")
    return changes.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*changes.columns)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a stored relation, by the marks that finished batches leave."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [n for n in names if n.startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(root, f"{n}/_SUCCESS"))]
    return sorted(int(n[1:]) for n in done)


def read_relation(spark: SparkSession, path: str, empty: DataFrame) -> DataFrame:
    """The newest version of a relation that :func:`update_stream` keeps, or ``empty`` without any."""
    found = _versions(spark, path)
    return spark.read.schema(empty.schema).parquet(f"{path}/v{found[-1]}") if found else empty


def update_stream(changes: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, once: bool = True) -> StreamingQuery:
    """Keep at ``path`` the relation of the latest row for each key of a stream of changes.

    Each micro-batch becomes a new version ``v<batch>``: the rows of the version before whose keys aren't in the
    batch, and the batch's latest rows that aren't older than what is there.  A batch that is run again after a failure starts from
    the version before it and writes the same version again, so every change counts once.
    """
    spark = changes.sparkSession
    none = spark.createDataFrame([], changes.schema)

    def merge(batch: DataFrame, number: int) -> None:
        earlier = [v for v in _versions(spark, path) if v < number]
        before = spark.read.schema(changes.schema).parquet(f"{path}/v{earlier[-1]}") if earlier else none
        touched = before.join(batch.select(*keys).distinct(), list(keys), "left_semi").select(*batch.columns)
        newest = latest_by_key(batch.unionByName(touched), keys, order)
        union_by_update(before, newest, keys).write.mode("overwrite").parquet(f"{path}/v{number}")

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def tumbling_counts(events: DataFrame, time: str, length: str, late: str, by: Sequence[str] = ()) -> DataFrame:
    """``(start, by, n)`` for windows of ``length``; rows more than ``late`` behind the newest are dropped from a stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    counted = rows.groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *by, "n")



__all__ = ["latest_by_key", "read_relation", "tumbling_counts", "update_stream"]
