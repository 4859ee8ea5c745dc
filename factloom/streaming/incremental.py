"""Streams: files as they arrive, and events by windows of their time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, folder: str, schema: str = "path string, content string, sha256 string") -> DataFrame:
    """Files not seen before, by path and digest."""
    return spark.readStream.schema(schema).parquet(folder).dropDuplicates(["path", "sha256"])


def distinct_events(events: DataFrame, late: str = "1 hour", key: str = "event_id") -> DataFrame:
    """The first event of each key.  On a stream, keys are forgotten once the watermark is past them, so the state is bounded by
    the events of that stretch: a copy that comes later than late after its twin's time passes again;
    events behind the watermark are dropped, from the second batch after it moved past them."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])


def handled(dispatched: DataFrame, consumed: DataFrame, key: list[str], within: int = 1800, late: str = "10 minutes", keep_unhandled: bool = True) -> DataFrame:
    """Dispatches (event_id, ts, ..key) with every consumption of the same key from their own time to within seconds after it.

    (dispatch_id, dispatched_at, ..key, consume_id, consumed_at), the last two null where nothing consumed it and
    keep_unhandled.  Null keys meet nothing.  On streams, both sides' rows are kept only as long as the interval and the
    watermarks (late) call for, and a dispatch is told unhandled once no consumption of it can come any more; rows later
    than late are dropped.  On tables the result is that of the same rows in time.  Times are dealt into stretches of within
    seconds, so a key with very many events is spread over them.
    """
    d = dispatched.select(F.col("event_id").alias("dispatch_id"), F.col("ts").cast("timestamp").alias("dispatched_at"), *key)
    c = consumed.select(F.col("event_id").alias("consume_id"), F.col("ts").cast("timestamp").alias("consumed_at"), *(F.col(k).alias(f"_c_{k}") for k in key))
    stretch = lambda at: F.floor(F.unix_seconds(at) / within)
    d = d.withColumn("_stretch", stretch("dispatched_at"))
    # what is consumed now was dispatched in this stretch or the one before
    c = c.withColumn("_c_stretch", F.explode(F.array(stretch("consumed_at"), stretch("consumed_at") - 1)))
    if d.isStreaming:
        d = d.withWatermark("dispatched_at", late)
    if c.isStreaming:
        c = c.withWatermark("consumed_at", late)
    same = (F.col("consumed_at") >= F.col("dispatched_at")) & (F.col("consumed_at") <= F.col("dispatched_at") + F.expr(f"interval {within} seconds")) & (F.col("_stretch") == F.col("_c_stretch"))
    for k in key:
        same = same & (F.col(k) == F.col(f"_c_{k}"))
    return d.join(c, same, "left_outer" if keep_unhandled else "inner").select("dispatch_id", "dispatched_at", *key, "consume_id", "consumed_at")


def scan_into(stream: DataFrame, detect: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Runs a detector over what is new and appends its findings, each batch under its own number, so a retried batch replaces itself."""

    def write(df: DataFrame, batch: int) -> None:
        detect(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows; works on a stream or a table."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withWatermark("ts", late) if events.isStreaming else events
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
