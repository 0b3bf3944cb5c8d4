"""Event streams: counts in time windows with a watermark, sessions, and keyed upserts of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, schema: str = EVENT, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def window_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, events, total) per window; on a stream, later events than ``late`` are dropped."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, events) of runs of a user's events with pauses of at most ``gap``."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.session_window(time, gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("events"))
    return g.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts a query that appends a stream's rows to a Parquet table exactly once, over what is there, then stops."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_batches(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that keeps a stream's micro-batches for ``read_upserted``, over what is there, then stops.

    A batch is written under its number and replaces what an interrupted try
    left there, so each counts once.
    """

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("_n", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{path}/_batch_no={n}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_upserted(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """The last row of each key over all micro-batches, in the order in which they came."""
    from keepsake.operators.lookups import last_by_key

    batches = spark.read.option("basePath", path).parquet(f"{path}/_batch_no=*")
    return last_by_key(batches, key, ["_batch_no", "_n"]).drop("_batch_no", "_n")
