"""Flat and nested forms of the request log, and the table that is written from it."""

from dataclasses import replace

from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, ScaleSettings
from trafficlens.operators.skew import new_path, split_hot
from trafficlens.session import SETTINGS, build_session
from trafficlens.sources import requests as req


def test_log_is_written_by_class(spark, requests):
    path = new_path(spark, "test-log")
    req.write_request_log(requests, path)
    found = spark.read.parquet(path)
    assert sorted(found.columns) == sorted(req.request_log(requests).columns) and found.count() == requests.count()
    plan = found.filter("traffic_class = 'human'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(traffic_class" in plan


def test_schema_of_the_log(requests):
    assert [(f.name, f.dataType) for f in requests.schema] == [(f.name, f.dataType) for f in req.REQUEST_SCHEMA]


def test_every_request_is_nested_once(requests):
    """Parts far smaller than the sessions, with one window per session and with hot sessions in pieces."""
    wanted = sorted((r["session_id"], r["timestamp_ms"], r["request_id"], r["headers"]["accept"]) for r in requests.collect())
    for config in (DEFAULT, replace(DEFAULT, scale=ScaleSettings(hot_rows=60, chunk_rows=10))):
        found = sorted(req.nested_sessions(requests, 9, config).collect(), key=lambda r: (r["session_id"], r["part_no"]))
        assert all(r["n_requests"] == len(r["requests"]) <= 9 for r in found)
        assert [(r["session_id"], x["timestamp_ms"], x["request_id"], x["headers"]["accept"]) for r in found for x in r["requests"]] == wanted
        full = [r for r, after in zip(found, found[1:]) if after["session_id"] == r["session_id"]]
        assert full and all(r["n_requests"] == 9 for r in full)


def test_summary_equals_nested(requests):
    summary = {r["session_id"]: r for r in req.session_summary(requests).collect()}
    nested = req.nested_sessions(requests, 100_000).withColumn("t", F.col("requests.timestamp_ms")).collect()
    assert len(summary) == len(nested)
    for r in nested:
        s = summary[r["session_id"]]
        assert (s["n_requests"], s["duration_ms"]) == (len(r["t"]), r["t"][-1] - r["t"][0])


def test_hot_keys_take_one_grouped_count(spark, requests):
    """Jobs that run while a frame with hot keys is laid out: one count per split, one write per hot part."""
    tracker, group = spark.sparkContext.statusTracker(), "hot-keys"
    spark.sparkContext.setJobGroup(group, group)
    split_hot(requests, ["session_id"], ["timestamp_ms", "request_id"], ScaleSettings(hot_rows=10_000))
    few = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= few <= 2


def test_session_settings(spark):
    session = build_session("test", 4)
    assert session.conf.get("spark.sql.adaptive.enabled") == SETTINGS["spark.sql.adaptive.enabled"]
    session.conf.set("spark.sql.session.timeZone", "America/New_York")
