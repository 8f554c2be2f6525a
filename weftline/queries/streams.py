"""Streams over the events, run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.materialize import shared_folder
from weftline.queries.registry import query, table
from weftline.streaming.update import read_relation, tumbling_counts, update_stream


@query("stream_latest_event", """
    SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    schema = table(spark, folder, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    changes = stream.select("user_id", "event_id", "event_type")
    home = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    update_stream(changes, f"{home}/relation", f"{home}/progress", ["user_id"], "event_id").awaitTermination()
    return read_relation(spark, f"{home}/relation", spark.createDataFrame([], changes.schema))


@query("stream_tumbling_counts", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL
""")  # fmt: skip
def _(spark: SparkSession, folder: str) -> DataFrame:
    counts = tumbling_counts(table(spark, folder, "events"), "ts", "1 hour", "2 hours", ["event_type"])
    return counts.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n")
