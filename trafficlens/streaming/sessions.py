"""Scoring a live stream: the requests of open sessions are state, and a session is scored once when it ends.

State holds, per key, the narrow rows of its open sessions (numbers and flags that features read) and the spans of
those sessions. An event-time timer fires when the watermark has passed the end of a span by the gap; the rows of
the session then leave the state and are scored by the same features and detectors as a table. The log is
never read again. Sessions that are still open when a stream ends are read from the state itself.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.features import features_of_rows, narrowed
from trafficlens.operators.mitigation import decide_in_context
from trafficlens.operators.skew import new_path
from trafficlens.plans.scoring import Detectors, score
from trafficlens.streaming.blocks import use_state_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_OUT = "key string, start_ms double, payload string"


def merged(spans: list[tuple[float, float]], times: pd.Series, gap_ms: float) -> list[tuple[float, float]]:
    """Spans (first, last) after more requests: those less than a gap apart are one."""
    ordered = np.sort(times.dropna().to_numpy(float))
    cuts = np.flatnonzero(np.diff(ordered) >= gap_ms)
    runs = zip(ordered[np.append(0, cuts + 1)].tolist(), ordered[np.append(cuts, -1)].tolist()) if len(ordered) else ()
    found: list[tuple[float, float]] = []
    for first, last in sorted([*spans, *runs]):
        if found and first - found[-1][1] < gap_ms:
            found[-1] = (found[-1][0], max(found[-1][1], last))
        else:
            found.append((first, last))
    return found


class OpenSessions(StatefulProcessor):
    """Per key: rows of open sessions as they came, and the spans they form.

    Rows that came together are one element of the list, and a key has one timer, for the first of its sessions that ends. It
    gives out all sessions that the watermark has passed, so the rows of a key are read once a batch however many sessions they form.
    """

    def __init__(self, gap_ms: float):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "at array<double>, payload array<string>")
        self.spans = handle.getValueState("spans", "firsts array<double>, lasts array<double>")

    def _known(self) -> list[tuple[float, float]]:
        found = self.spans.get()
        return list(zip(*found)) if found else []

    def _keep(self, spans: list[tuple[float, float]]) -> None:
        self.spans.update(([a for a, _ in spans], [b for _, b in spans]))

    def _end(self, last: float) -> int:
        """The first whole millisecond at which nothing can join a session any more."""
        return int(-(-(last + self.gap_ms) // 1))

    def _first_end(self, spans: list[tuple[float, float]]) -> list[int]:
        return [self._end(spans[0][1])] if spans else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        before = self._known()
        spans = before
        for chunk in rows:
            self.rows.appendValue((chunk["at"].tolist(), chunk["payload"].tolist()))
            spans = merged(spans, chunk["at"], self.gap_ms)
        self._keep(spans)
        old, new = self._first_end(before), self._first_end(spans)
        if old != new:
            for end in old:
                self.handle.deleteTimer(end)
            for end in new:
                self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, spans = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), self._known()
        # spans are in order and a gap apart, so those that have ended come first
        done = [s for s in spans if self._end(s[1]) <= now]
        if not done:
            return
        firsts, last = np.array([a for a, _ in done]), done[-1][1]
        left = []
        for times, payloads in self.rows.get():
            at, payload = np.array(times, float), np.array(payloads, object)
            ended = at <= last
            if ended.any():
                starts = firsts[np.searchsorted(firsts, at[ended], "right") - 1]
                yield pd.DataFrame({"key": key[0], "start_ms": starts, "payload": payload[ended]})
            if not ended.all():
                left.append((at[~ended].tolist(), payload[~ended].tolist()))
        spans = spans[len(done):]
        if spans:
            self.rows.put(left)
            self._keep(spans)
            for end in self._first_end(spans):
                self.handle.registerTimer(end)
        else:
            self.rows.clear()
            self.spans.clear()

    def close(self) -> None:
        pass


def _row_type(requests: DataFrame):
    return narrowed(requests.withColumn("session_id", F.lit(""))).drop("session_id").schema


def closed_session_rows(requests: DataFrame, key: str, delay: str = "10 minutes", config: Settings = DEFAULT) -> DataFrame:
    """A stream of requests to (key, start_ms, payload): one row per request of every session that has ended, in append mode.

    Requests without a key are left out. Needs the RocksDB store (`blocks.use_state_store`).
    """
    # rows travel as text, so that the state has one form whatever the columns are
    rows = narrowed(requests.withColumn("session_id", F.col(key).cast("string")))
    packed = rows.select(F.col("session_id").alias("key"), fn.event_time(F.col("timestamp_ms")).alias("ts"), F.col("timestamp_ms").cast("double").alias("at"),
                         F.to_json(F.struct(*[c for c in rows.columns if c != "session_id"])).alias("payload"))
    timed = packed.filter(F.col("key").isNotNull()).withWatermark("ts", delay)
    gap = config.features.session_gap_seconds * 1000.0
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=OpenSessions(gap), outputStructType=ROWS_OUT, outputMode="Append", timeMode="EventTime")


def session_rows(emitted: DataFrame, requests: DataFrame) -> DataFrame:
    """Narrow rows with the id of their session, key@start, from what `closed_session_rows` gives out."""
    unpacked = emitted.select(F.concat_ws("@", "key", F.floor("start_ms").cast("bigint")).alias("session_id"),
                              F.from_json("payload", _row_type(requests)).alias("r"))
    return unpacked.select("session_id", "r.*")


def open_session_rows(spark: SparkSession, checkpoint: str, config: Settings = DEFAULT) -> DataFrame:
    """(key, start_ms, payload) of the sessions that the stopped stream of this checkpoint still holds."""
    state = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows")
             .option("flattenCollectionTypes", "true").load())
    rows = state.select(F.col("key.key").alias("key"), F.inline(F.arrays_zip("list_element.at", "list_element.payload")))
    # few rows of a key are open at a time: what came within the delay and the gap
    ordered = Window.partitionBy("key").orderBy("at")
    gap = config.features.session_gap_seconds * 1000.0
    starts = rows.withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(ordered) >= gap, F.lit(True)).cast("int"))
    numbered = starts.withColumn("_no", F.sum("_new").over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.select("key", F.min("at").over(Window.partitionBy("key", "_no")).alias("start_ms"), "payload")


@dataclass(frozen=True)
class StreamScores:
    """Where a scored stream writes: rows of ended sessions, scores and decisions, one folder per batch, and its checkpoint."""

    path: str

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.option("mergeSchema", "true").parquet(f"{self.path}/{table}")


def score_stream(requests: DataFrame, key: str, detectors: Detectors | None = None, config: Settings = DEFAULT, path: str | None = None,
                 finish: bool = True, delay: str = "10 minutes") -> StreamScores:
    """Score and decide every session of a stream as it ends, by all layers that `detectors` has.

    Runs through the input that is there now; a later call on the same path goes on from there. `finish` scores the
    sessions that are open at the end as well, in a folder of their own. A batch that runs again replaces its folders.
    """
    spark = requests.sparkSession
    use_state_store(spark)
    found = StreamScores(path or new_path(spark, "stream-scores"))
    plain = requests.limit(0) if not requests.isStreaming else spark.createDataFrame([], requests.schema)

    def write(emitted: DataFrame, name: str) -> None:
        # stored first: scoring reads the rows more than once, and state must move once
        emitted.write.mode("overwrite").parquet(f"{found.path}/rows/{name}")
        rows = session_rows(spark.read.schema(ROWS_OUT).parquet(f"{found.path}/rows/{name}"), plain)
        scored = score(features_of_rows(rows, config), detectors, config)
        scored.write.mode("overwrite").parquet(f"{found.path}/scores/{name}")
        stored = spark.read.schema(scored.schema).parquet(f"{found.path}/scores/{name}")
        decide_in_context(stored, config).write.mode("overwrite").parquet(f"{found.path}/decisions/{name}")

    query = (closed_session_rows(requests, key, delay, config).writeStream.outputMode("append")
             .foreachBatch(lambda batch, i: write(batch, f"batch={i}")).option("checkpointLocation", f"{found.path}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if finish:
        write(open_session_rows(spark, f"{found.path}/checkpoint", config), "batch=-1")
    return found
