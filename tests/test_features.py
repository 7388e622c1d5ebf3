"""Features against loops, on edge cases, on the log, and under hot keys."""

from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from trafficlens.operators import extras, sequence
from trafficlens.operators.features import (FAMILIES, FEATURE_NAMES, clean_features, family_features, session_features,
                                            value_entropy)
from trafficlens.operators.skew import number_rows
from trafficlens.sources.requests import REQUEST_SCHEMA, read_events, requests_from_events

FULL = {h: "1" for h in ("accept", "accept-language", "accept-encoding", "sec-fetch-dest", "sec-ch-ua", "a", "b", "c", "d", "e")}


def session(name, times, urls, status=None, agents=None, headers=FULL, api=None):
    """Request rows of one hand-written session."""
    rows = []
    for i, t in enumerate(times):
        url = urls[i % len(urls)]
        rows.append({
            "session_id": name, "request_id": len(times) * 1000 + i, "seq": i + 1, "timestamp_ms": float(t), "method": "GET",
            "url": url, "status_code": (status or [200])[i % len(status or [200])], "response_time_ms": 80.0,
            "headers": headers, "user_agent": (agents or ["Mozilla"])[i % len(agents or ["Mozilla"])], "ip": "1.1.1.1",
            "request_size_bytes": 100 + i, "response_size_bytes": 5000 + 37 * i, "is_api": bool(api), "referrer": "" if i % 2 else "x",
            "traffic_class": "human", "label": 0, "asn": None, "ja3": None})
    return rows


def steps(*gaps):
    out = [1000.0]
    for g in gaps:
        out.append(out[-1] + g)
    return out


EDGE = [
    session("one", [5.0], ["/"]),
    *[session(f"n{n}", steps(*[1000 + 10 * i for i in range(n - 1)]), ["/a/b", "/c", "/api/x?q=1", "/c"])
      for n in (2, 3, 4, 5, 20, 21, 65, 66)],
    session("same time", [7.0] * 6, ["/a", "/b"]),
    session("cv low", steps(*[100, 100.1] * 10), ["/a/1", "/a/2", "/b/1"]),
    session("cv mid", steps(*[85, 115] * 10), ["/a/1", "/a/2", "/b/1"]),
    session("cv high", steps(*[60, 140] * 10), ["/a/1"]),
    session("two agents", steps(5, 5, 5), ["/a"], agents=["Mozilla", "Safari"]),
    session("bot agent", steps(5, 5, 5), ["/a"], agents=["Python-urllib"], headers={"accept": "1"}),
    session("back", steps(*[50] * 5), ["/A", "/B", "/A", "/B", "/C", "/A"]),
    session("odd urls", steps(*[500] * 5), ["/", "x", "/a/b/", "http://h/p", "", "/search?q=a/b"]),
    session("only plain", steps(*[500] * 5), ["x", "y", "x?1"], api=True),
    session("error last", steps(*[500] * 5), ["/a"], status=[200, 200, 404, 200, 500, 503], headers={str(i): "1" for i in range(7)}),
    session("api flags", steps(*[700] * 5), ["/q?a", "/q?b", "/r"], api=True, headers={str(i): "1" for i in range(5)}),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [tuple(r[f.name] for f in REQUEST_SCHEMA) for s in EDGE for r in s]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def compare(frame, expected):
    found = {r["session_id"]: r for r in frame.collect()}
    assert set(found) == set(expected)
    for name, want in expected.items():
        wrong = {k: (found[name][k], v) for k, v in want.items() if not brute.same(found[name][k], v)}
        assert not wrong, (name, wrong)


def by_session(rows):
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["timestamp_ms"], r["request_id"])):
        groups[r["session_id"]].append(r)
    return groups


def test_there_are_51_features():
    assert len(FEATURE_NAMES) == 51 == len(set(FEATURE_NAMES))
    assert [sum(n.startswith(p) for n in FEATURE_NAMES) for p in ("http_", "beh_", "llm_")] == [29, 14, 8]


def test_edge_cases(edge):
    compare(session_features(edge), {s[0]["session_id"]: brute.features(s) for s in EDGE})


def test_edge_cases_when_sessions_are_hot(edge, small_scale):
    from dataclasses import replace
    from trafficlens.config import ScaleSettings
    tiny = replace(small_scale, scale=ScaleSettings(hot_rows=4, chunk_rows=2))
    compare(session_features(edge, tiny), {s[0]["session_id"]: brute.features(s) for s in EDGE})


def test_log_equals_loops(requests):
    groups = by_session([r.asDict() for r in requests.collect()])
    compare(session_features(requests), {k: brute.features(v) for k, v in groups.items()})


def rounded(frame, names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                  for r in frame.select("session_id", *names).collect())


def test_hot_sessions_give_the_same_features(requests, small_scale):
    names = [*FEATURE_NAMES, "n_requests", "last_url", "user_agent", "start_ms", "end_ms"]
    assert requests.groupBy("session_id").count().filter("count > 60").count() > 3
    assert rounded(session_features(requests, small_scale), names) == rounded(session_features(requests), names)


def test_hot_users_give_the_same_requests(spark, folder, small_scale):
    events = read_events(spark, folder)
    plain, hot = requests_from_events(events), requests_from_events(events, small_scale)
    assert sorted(map(str, plain.collect())) == sorted(map(str, hot.collect()))


@pytest.mark.parametrize("operator", [sequence.gaps, sequence.url_steps, extras.consecutive_404s, extras.regular_runs,
                                      extras.sessionize_gap, extras.iat_histogram])
def test_hot_keys_give_the_same_sequences(requests, small_scale, operator):
    plain = sorted(map(tuple, operator(requests).collect()))
    assert sorted(map(tuple, operator(requests, small_scale).collect())) == plain


def test_order_of_rows_does_not_matter(requests):
    mixed = requests.repartition(7, F.xxhash64("request_id")).sortWithinPartitions(F.desc("url"))
    assert rounded(session_features(mixed), FEATURE_NAMES) == rounded(session_features(requests), FEATURE_NAMES)


def test_one_session_alone_equals_the_batch(requests):
    alone = rounded(session_features(requests.filter("session_id = '3'")), FEATURE_NAMES)
    assert alone == [r for r in rounded(session_features(requests), FEATURE_NAMES) if r[0] == "3"]


@pytest.mark.parametrize("family", FAMILIES)
def test_families_equal_the_full_vector(requests, edge, family):
    names = FAMILIES[family].names
    both = requests.unionByName(edge)
    assert rounded(family_features(both, family), names) == rounded(session_features(both), names)


def test_features_take_one_shuffle(spark, folder):
    from trafficlens.plans.queries import requests as log
    plan = session_features(log(spark, folder))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan


def test_families_read_only_their_columns(requests):
    plan = family_features(requests, "http_status_rates")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<session_id:string,status_code:int>" in plan


def test_clean_features(spark):
    frame = spark.sql("select double('NaN') a, double('Infinity') b, double('-Infinity') c, cast(null as double) d, 2D e")
    assert tuple(clean_features(frame, list("abcde")).first()) == (0.0, 1e6, -1e6, 0.0, 2.0)


def test_value_entropy(spark):
    frame = spark.createDataFrame([("k", v) for v in "aabbbc"], "key string, v string")
    assert brute.same(value_entropy(frame, ["key"], "v").first()["entropy"], brute.entropy("aabbbc"))


def test_number_rows(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["row_no"] == r["v"] + 1 for r in number_rows(frame, [F.col("v")]).collect())


def test_peak_rpm_equals_loops(requests):
    found = {r["session_id"]: r["peak_rpm"] for r in extras.peak_rpm(requests).collect()}
    for name, rows in by_session([r.asDict() for r in requests.collect()]).items():
        times = [r["timestamp_ms"] for r in rows]
        assert found[name] == max(sum(t - 59999 <= s <= t for s in times) for t in times)
