"""Event-time windows on streams, and running a stream to the end of its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.skew import new_path


def with_event_time(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Adds ts from timestamp_ms and the watermark."""
    return requests.withColumn("ts", fn.event_time(F.col("timestamp_ms"))).withWatermark("ts", delay)


def closed_sessions(timed: DataFrame, key: str, config: Settings = DEFAULT) -> DataFrame:
    """Sessions of a key by gap, with counts only: state stays a few numbers per open session.

    In append mode a session comes out once the watermark has passed its end.
    """
    gap = f"{config.features.session_gap_seconds} seconds"
    return (timed.groupBy(F.session_window("ts", gap).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n_requests"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
            .select(key, F.unix_millis("first_ts").alias("start_ms"), F.unix_millis("last_ts").alias("end_ms"),
                    "n_requests"))


def rates(timed: DataFrame, key: str, length: str = "1 minute", slide: str | None = None,
          limit: int = DEFAULT.mitigation.throttle_rpm) -> DataFrame:
    """Requests per key and event-time window."""
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    return (timed.groupBy(key, frame.alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
            .select(key, F.unix_millis("w.start").alias("window_start_ms"), "n_requests",
                    (F.col("n_requests") > limit).alias("over_limit")))


def with_open_sessions(closed: DataFrame, requests: DataFrame, key: str, config: Settings = DEFAULT) -> DataFrame:
    """Closed sessions of a stream that has ended, and those still open then, from the rows after each key's last closed one."""
    last = closed.groupBy(key).agg(F.max("end_ms").alias("_last"))
    rest = (requests.join(last, key, "left").filter(F.col("_last").isNull() | (F.floor("timestamp_ms") > F.col("_last")))
            .withColumn("ts", fn.event_time(F.col("timestamp_ms"))))
    return closed.unionByName(closed_sessions(rest, key, config))


def with_open_windows(done: DataFrame, requests: DataFrame, key: str, length: str = "1 minute", slide: str | None = None,
                      limit: int = DEFAULT.mitigation.throttle_rpm) -> DataFrame:
    """Windows of a stream that has ended, and those that its watermark had not passed: all that begin after the last one given out."""
    last = done.groupBy().agg(F.coalesce(F.max("window_start_ms"), F.lit(-2**62)).alias("m"))
    later = requests.filter(F.col("timestamp_ms") > last.scalar()).withColumn("ts", fn.event_time(F.col("timestamp_ms")))
    rest = rates(later, key, length, slide, limit).filter(F.col("window_start_ms") > last.scalar())
    return done.unionByName(rest)


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process all input that is there now into a parquet table and read it."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    query = (stream.writeStream.outputMode(mode).format("parquet").option("path", f"{out}/table")
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/table")


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], name: str,
                mode: str = "append") -> StreamingQuery:
    out = new_path(stream.sparkSession, name)
    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a file stream: user, time in ms and event id."""
    table = f"{folder}/events.parquet"
    schema = spark.read.parquet(table).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return _timed_users(events)


def event_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows as a table."""
    return _timed_users(spark.read.parquet(f"{folder}/events.parquet"))


def _timed_users(events: DataFrame) -> DataFrame:
    return events.select("user_id", (fn.epoch_micros(F.col("ts")) / 1000.0).alias("timestamp_ms"))
