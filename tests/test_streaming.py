"""Streams give what the batch gives for everything the watermark has closed."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from trafficlens.config import DEFAULT, ModelSettings
from trafficlens.operators import extras, mitigation
from trafficlens.operators.features import session_features
from trafficlens.operators.skew import new_path
from trafficlens.plans import scoring
from trafficlens.sources.requests import read_events
from trafficlens.streaming import blocks, sessions, windows


@pytest.fixture(scope="module")
def log(spark):
    """Requests of a few addresses with pauses, as a stored log."""
    rows = []
    for user in range(6):
        t = 1_700_000_000_000 + user * 1000
        for i in range(60):
            t += 700_000 if i % (7 + user) == 6 else 5_000 + 13 * i
            rows.append((user * 1000 + i, f"10.0.0.{user}", float(t), f"/p/{i % 5}", 404 if i % 9 == 0 else 200))
    frame = spark.createDataFrame(rows, "request_id long, ip string, timestamp_ms double, url string, status_code int")
    full = frame.select(
        "*", F.concat_ws("-", "ip", "request_id").alias("session_id"), F.lit("GET").alias("method"),
        F.create_map(F.lit("accept"), F.lit("1")).alias("headers"), F.lit("curl/8").alias("user_agent"),
        F.lit(200).cast("bigint").alias("request_size_bytes"), F.lit(900).cast("bigint").alias("response_size_bytes"),
        F.lit(False).alias("is_api"), F.lit(None).cast("string").alias("referrer"),
        F.lit("human").alias("traffic_class"), F.lit(0).alias("label"))
    path = new_path(spark, "test-log")
    full.write.parquet(path)
    return path


def stream_of(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def batch_sessions(spark, log):
    rows = spark.read.parquet(log)
    mark = rows.agg(F.max("timestamp_ms")).first()[0] - 600_000
    return extras.sessionize_gap(rows).filter(F.col("end_ms") + 300_000 <= mark)


def test_closed_sessions_equal_the_batch(spark, log):
    timed = windows.with_event_time(stream_of(spark, log))
    found = windows.run_to_end(windows.closed_sessions(timed, "ip"), "test-sessions").collect()
    want = batch_sessions(spark, log).collect()
    assert len(want) > 20
    assert sorted((r["ip"], r["start_ms"], r["end_ms"], r["n_requests"]) for r in found) == sorted(
        (r["ip"], int(r["start_ms"]), int(r["end_ms"]), r["n_requests"]) for r in want)


def test_rates_equal_the_batch(spark, log):
    timed = windows.with_event_time(stream_of(spark, log))
    for slide, length in ((None, "1 minute"), ("1 minute", "5 minutes")):
        found = windows.run_to_end(windows.rates(timed, "ip", length, slide), "test-rates")
        want = extras.rpm_windows(spark.read.parquet(log), "ip", length, slide)
        missing = want.exceptAll(found)
        assert found.exceptAll(want).count() == 0 and found.count() > 50
        last = spark.read.parquet(log).agg(F.max("timestamp_ms")).first()[0]
        assert missing.filter(F.col("window_start_ms") + 60_000 < last - 600_000 - 300_000).count() == 0


def test_nothing_is_missing_at_the_end(spark, log):
    rows = spark.read.parquet(log)
    timed = windows.with_event_time(stream_of(spark, log))
    closed = windows.run_to_end(windows.closed_sessions(timed, "ip"), "test-sessions")
    found = windows.with_open_sessions(closed, rows, "ip").collect()
    want = extras.sessionize_gap(rows).collect()
    assert len(found) > closed.count()
    assert sorted((r["ip"], r["start_ms"], r["end_ms"], r["n_requests"]) for r in found) == sorted(
        (r["ip"], int(r["start_ms"]), int(r["end_ms"]), r["n_requests"]) for r in want)
    for slide, length in ((None, "1 minute"), ("1 minute", "5 minutes")):
        done = windows.run_to_end(windows.rates(timed, "ip", length, slide), "test-rates")
        whole = windows.with_open_windows(done, rows, "ip", length, slide)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, extras.rpm_windows(rows, "ip", length, slide).collect()))


def sessions_of(rows, gap=300_000):
    """Rows with the id of their session, by a plain window."""
    order = Window.partitionBy("ip").orderBy("timestamp_ms", "request_id")
    new = F.coalesce(F.col("timestamp_ms") - F.lag("timestamp_ms").over(order) >= gap, F.lit(True)).cast("int")
    numbered = rows.withColumn("_new", new).withColumn("_no", F.sum("_new").over(order))
    start = F.min("timestamp_ms").over(Window.partitionBy("ip", "_no"))
    return numbered.withColumn("session_id", F.concat_ws("@", "ip", F.floor(start).cast("bigint"))).drop("_new", "_no")


SCORES = ["session_id", "n_requests", "statistical_score", "llm_score", "isolation_score", "gb_score", "risk_score", "explanation"]


def equal_scores(spark, found, rows, detectors=None):
    whole = scoring.score(session_features(sessions_of(rows)), detectors)
    want, got = whole.select(SCORES).collect(), found.read(spark, "scores").select(SCORES).collect()
    rounded = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(rounded, got)) == sorted(map(rounded, want))
    decided = found.read(spark, "decisions").select("session_id", "page_context", "action").collect()
    assert sorted(map(tuple, decided)) == sorted(map(tuple, mitigation.decide_in_context(whole).select("session_id", "page_context", "action").collect()))
    return len(want)


def test_every_session_of_a_stream_is_scored_from_state(spark, log):
    rows = spark.read.parquet(log)
    found = sessions.score_stream(stream_of(spark, log), "ip")
    assert equal_scores(spark, found, rows) > 40
    # the log was read by the stream alone: rows that left the state are those of the log
    assert found.read(spark, "rows").count() == rows.count()


def test_shuffled_arrival_and_a_second_run(spark, log):
    """Sessions that reach over two runs, rows out of order within the delay, an address without a value."""
    rows = spark.read.parquet(log).orderBy("timestamp_ms")
    cut = rows.agg(F.expr("percentile(timestamp_ms, 0.5)")).first()[0]
    store, out = new_path(spark, "test-arrivals"), new_path(spark, "test-scores")
    # about four minutes out of order
    early = F.col("timestamp_ms") + F.pmod(F.xxhash64("request_id"), F.lit(240_000)) < cut
    rows.filter(early).orderBy(F.rand(1)).write.parquet(store)
    first = sessions.score_stream(stream_of(spark, store), "ip", path=out, finish=False)
    before = first.read(spark, "scores").count()
    rows.filter(~early).unionByName(rows.limit(3).withColumn("ip", F.lit(None).cast("string"))).orderBy(F.rand(2)).write.mode("append").parquet(store)
    found = sessions.score_stream(stream_of(spark, store), "ip", path=out)
    assert 0 < before < equal_scores(spark, found, rows)


def test_all_layers_on_a_stream(spark, log, requests):
    features = session_features(requests)
    small = replace(DEFAULT, models=ModelSettings(boost_trees=5, forest_trees=10))
    fitted = scoring.fit_detectors(features, small)
    found = sessions.score_stream(stream_of(spark, log), "ip", fitted)
    equal_scores(spark, found, spark.read.parquet(log), fitted)
    assert found.read(spark, "scores").select("gb_score").distinct().count() > 0


def test_empty_stream(spark, log):
    empty = new_path(spark, "test-empty")
    spark.read.parquet(log).limit(0).write.parquet(empty)
    found = sessions.score_stream(stream_of(spark, empty), "ip")
    assert found.read(spark, "decisions").count() == 0


def test_spans_merge():
    times = pd.Series([5.0, 100.0, 104.9, 90.0])
    assert sessions.merged([], times, 10.0) == [(5.0, 5.0), (90.0, 90.0), (100.0, 104.9)]
    assert sessions.merged([(14.0, 20.0), (110.0, 111.0)], times, 10.0) == [(5.0, 20.0), (90.0, 90.0), (100.0, 111.0)]


class FakeState:
    """The state of one key: its list, its value and its timers, with the number of reads of the list."""

    def __init__(self):
        self.items, self.value, self.timers, self.reads = [], None, set(), 0

    def getListState(self, *_):
        return self

    def getValueState(self, *_):
        return FakeValue(self)

    def get(self):
        self.reads += 1
        return iter(list(self.items))

    def appendValue(self, row):
        self.items.append(row)

    def appendList(self, rows):
        self.items += rows

    def put(self, rows):
        self.items = list(rows)

    def clear(self):
        self.items = []

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class FakeValue:
    def __init__(self, state):
        self.state = state

    def exists(self):
        return self.state.value is not None

    def get(self):
        return self.state.value

    def update(self, row):
        self.state.value = row

    def clear(self):
        self.state.value = None


def fire(processor, state, watermark):
    """Timers as the engine fires them: those there at the start, in order, each deleted after its call."""
    found = []
    for at in sorted(t for t in state.timers if t < watermark):
        found += processor.handleExpiredTimer(("k",), TimerValues(0, watermark), ExpiredTimerInfo(at))
        processor.handle.deleteTimer(at)
    return pd.concat(found) if found else pd.DataFrame(columns=["key", "start_ms", "payload"])


def test_rows_of_a_key_are_read_once_however_many_sessions_end():
    state = FakeState()
    processor = sessions.OpenSessions(10.0)
    processor.init(state)
    # 50 sessions of 20 rows, 200 apart, dealt over two chunks, and one row without a time
    rows = [(200.0 * s + 5 * i, f"{s}:{i}") for i in range(20) for s in range(50)] + [(float("nan"), "none")]
    chunks = [pd.DataFrame(rows[k::2], columns=["at", "payload"]) for k in (0, 1)]
    processor.handleInputRows(("k",), iter(chunks), None)
    assert len(state.items) == 2 and state.timers == {105}
    assert len(fire(processor, state, 105)) == 0
    ended = fire(processor, state, 3990)
    assert state.reads == 1 and len(state.timers) == 1
    assert sorted(zip(ended["start_ms"], ended["payload"])) == sorted((200.0 * s, f"{s}:{i}") for s in range(20) for i in range(20))
    # two rows that the next session begins with
    before = len(state.items)
    processor.handleInputRows(("k",), iter([pd.DataFrame({"at": [3999.0, 3995.5], "payload": ["x", "y"]})]), None)
    assert len(state.items) == before + 1
    assert state.timers == {4105}
    rest = fire(processor, state, 10_000)
    assert sorted(rest["payload"][rest["start_ms"] == 3995.5]) == sorted([*(f"20:{i}" for i in range(20)), "x", "y"])
    assert state.reads == 2 and not state.timers and not state.items and state.value is None
    assert len(rest) + len(ended) == 1002


DECISIONS = [("a", "block", 0), ("a", "block", 1_000_000), ("a", "monitor", 2_000_000), ("a", "block", 4_500_000),
             ("a", "block", 9_000_000), ("b", "block", 500), ("b", "block", 3_600_499), ("c", "allow", 1)]


def decisions(spark, rows):
    return spark.createDataFrame([(ip, act, float(1_700_000_000_000 + at)) for ip, act, at in rows],
                                 "ip string, action string, end_ms double").coalesce(1)


def test_block_intervals(spark):
    found = {(r["ip"], r["blocked_from_ms"] - 1_700_000_000_000, r["blocked_until_ms"] - 1_700_000_000_000, r["n_blocks"])
             for r in blocks.block_intervals(decisions(spark, DECISIONS)).collect()}
    assert found == {("a", 0, 8_100_000, 3), ("a", 9_000_000, 12_600_000, 1), ("b", 500, 7_200_499, 2)}


def test_live_blocks_over_two_batches(spark):
    store, seen = new_path(spark, "test-live"), []
    blocks.use_state_store(spark)
    name = new_path(spark, "test-live-checkpoint")

    def run(rows):
        decisions(spark, rows).write.mode("append").parquet(store)
        stream = spark.readStream.schema("ip string, action string, end_ms double").parquet(store)
        query = (blocks.live_blocks(stream).writeStream.outputMode("update").option("checkpointLocation", name)
                 .foreachBatch(lambda df, i: seen.extend(df.collect())).trigger(availableNow=True).start())
        query.awaitTermination()
        latest = {r["ip"]: (r["blocked_from_ms"] - 1_700_000_000_000, r["blocked_until_ms"] - 1_700_000_000_000, r["n_blocks"])
                  for r in seen}
        return latest

    first = run(DECISIONS[:4] + [("b", "block", 1_500_000)])
    assert first == {"a": (0, 8_100_000, 3), "b": (1_500_000, 5_100_000, 1)}
    # the watermark is now at 3,900,000: the row of c is late and is dropped
    second = run([("b", "block", 5_000_000), ("a", "block", 9_000_000), ("c", "block", 3_000_000)])
    assert second == {"a": (9_000_000, 12_600_000, 1), "b": (1_500_000, 8_600_000, 2)}


def test_event_stream_reads_the_whole_table(spark, folder):
    stream = windows.event_stream(spark, folder)
    assert windows.run_to_end(stream, "test-events").count() == read_events(spark, folder).count()


def test_merge_blocks():
    assert blocks.merge_blocks([(50, 60, 1), (0, 10, 1), (9, 19, 2), (19, 29, 1)]) == [(0, 19, 3), (19, 29, 1), (50, 60, 1)]
