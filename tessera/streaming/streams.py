"""Structured Streaming twins of the telemetry operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import shared_dir

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, ts: str = "ts", delay: str = "1 hour", files: int = 1000) -> DataFrame:
    """A file stream of events with a watermark, at most ``files`` a micro-batch; the time column becomes a zoned timestamp, which watermarks need."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def window_counts(stream: DataFrame, width: str, ts: str = "ts", by: tuple[str, ...] = ("event_type",), error: Column | None = None) -> DataFrame:
    """Counts, error rate and largest value of tumbling windows."""
    error = error if error is not None else F.col("event_type") == "error"
    grouped = stream.groupBy(F.window(ts, width).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), F.avg(F.when(error, 1.0).otherwise(0.0)).alias("error_rate"), F.max("value").alias("top")).select(F.col("w.start").alias("start"), *by, "n", "error_rate", "top")


def sliding_counts(stream: DataFrame, width: str, slide: str, ts: str = "ts") -> DataFrame:
    """Sliding windows: every event counts in each window that holds it."""
    return stream.groupBy(F.window(ts, width, slide).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(stream: DataFrame, by: str, gap: str, ts: str = "ts") -> DataFrame:
    """Events of a key grouped into sessions that a gap ends."""
    return stream.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Each key once; state is kept as long as the watermark allows a repeat."""
    return stream.dropDuplicatesWithinWatermark(keys)


def correlated(errors: DataFrame, purchases: DataFrame, within: str, key: str = "user_id") -> DataFrame:
    """Stream-stream join by key and time range; both sides' watermarks bound the state."""
    a = errors.select(F.col(key).alias("k"), F.col("ts").alias("ets"), F.col("event_id").alias("error_id"))
    b = purchases.select(F.col(key), F.col("ts").alias("pts"), F.col("event_id").alias("purchase_id"))
    return a.join(b, (F.col("k") == F.col(key)) & (F.col("pts") >= F.col("ets")) & (F.col("pts") <= F.col("ets") + F.expr(f"INTERVAL {within}"))).select(key, "error_id", "purchase_id")


def health_states(stream: DataFrame, failures: int = 2, successes: int = 3, idle: int = 30 * 24 * 3600) -> DataFrame:
    """Hysteresis per user with custom state: streak, last outcome, state.

    Events of one micro-batch are taken in order of time and id. A user's state
    is dropped once the watermark is ``idle`` seconds past the last event; the
    user then starts anew.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        streak, last, current = state.get if state.exists else (0, False, "unknown")
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        states = []
        for ok in rows["event_type"] != "error":
            streak = streak + 1 if streak and ok == last else 1
            last = bool(ok)
            if not ok and streak >= failures:
                current = "unhealthy"
            elif ok and streak >= successes:
                current = "healthy"
            states.append(current)
        state.update((streak, last, current))
        newest = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle * 1000)
        yield pd.DataFrame({"session_id": rows["user_id"], "event_id": rows["event_id"], "state": states})

    return stream.groupBy("user_id").applyInPandasWithState(
        step, "session_id bigint, event_id bigint, state string", "streak int, last boolean, state string", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_to_table(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drain a stream (trigger availableNow) into a Parquet table and read it.

    Append mode uses the exactly-once file sink and gives windows and sessions
    once the watermark has passed their end; complete mode keeps all and
    overwrites the table with each micro-batch. Tables and checkpoints live in the shared
    folder that ``spark.checkpoint.dir`` names.
    """
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{path}/table").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/table")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
