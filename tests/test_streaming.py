from __future__ import annotations

import shutil

from pyspark.sql import functions as F

from weftline.streaming.update import latest_by_key, read_relation, tumbling_counts, update_stream

SCHEMA = "k long, at long, v string"


def test_latest_by_key(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x"), (2, 1, "y")], SCHEMA)
    assert sorted(tuple(r) for r in latest_by_key(rows, ["k"], "at").collect()) == [(1, 3, "c"), (2, 1, "y")]


def test_changes_over_several_runs_and_a_repeated_batch(spark, tmp_path):
    source, store, progress = (str(tmp_path / n) for n in ("source", "store", "progress"))
    none = spark.createDataFrame([], SCHEMA)

    def run():
        changes = spark.readStream.schema(SCHEMA).parquet(source)
        update_stream(changes, store, progress, ["k"], "at").awaitTermination()
        return sorted(tuple(r) for r in read_relation(spark, store, none).collect())

    spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], SCHEMA).write.parquet(source)
    assert run() == [(1, 5, "a"), (2, 1, "b")]
    spark.createDataFrame([(1, 4, "late"), (2, 2, "new"), (3, 1, "c")], SCHEMA).write.mode("append").parquet(source)
    want = [(1, 5, "a"), (2, 2, "new"), (3, 1, "c")]
    assert run() == want and run() == want
    shutil.rmtree(progress)  # all batches again, over the versions that are there
    assert run() == want


def test_tumbling_counts(spark):
    rows = spark.createDataFrame([(0, "a"), (59, "a"), (60, "b")], "s long, kind string").select(F.timestamp_seconds("s").alias("ts"), "kind")
    assert sorted((r.kind, r.n) for r in tumbling_counts(rows, "ts", "1 minute", "1 minute", ["kind"]).collect()) == [("a", 2), ("b", 1)]
