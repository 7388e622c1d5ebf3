"""Rules, agent detector, ensemble, decisions and evaluation."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, MitigationSettings, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators import detectors, evaluation, extras, mitigation
from trafficlens.operators.features import session_features
from trafficlens.plans import scoring


@pytest.fixture(scope="module")
def features(requests):
    from trafficlens.operators.skew import materialize
    return materialize(session_features(requests), "test-features")


@pytest.fixture(scope="module")
def scored(features):
    return scoring.score(features)


def frame(spark, labels, scores, classes=None):
    rows = [(str(i), (classes or ["human", "llm_agent"])[y] if not classes or len(classes) == 2 else classes[i], y, float(s))
            for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "session_id string, traffic_class string, y_true int, y_score double")


# --- settings and scalar helpers ---------------------------------------------------------------

def test_settings_are_consistent():
    assert abs(sum(DEFAULT.agent.weights.values()) - 1) < 1e-9
    e = DEFAULT.ensemble
    assert abs(e.statistical + e.isolation + e.boosting + e.agent - 1) < 1e-9
    floors = list(DEFAULT.mitigation.floors.values())
    assert floors == sorted(floors, reverse=True)


def test_rounding_equals_python(spark):
    random.seed(3)
    values = [0.0, 1.0, 0.5, 0.12345, 0.53125, 0.0625, 0.5125, 0.4375, 0.1235, 0.99995, 0.00005, 0.29999999999999993]
    values += [random.random() for _ in range(500)] + [round(random.random(), 4) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    found = rows.selectExpr("v", f"{fn.exact_round('v')} as r", f"{fn.exact_text('v', 3)} as t", f"{fn.exact_text('v', 2)} as u")
    for r in found.collect():
        assert (r["r"], r["t"], r["u"]) == (round(r["v"], 4), f"{r['v']:.3f}", f"{r['v']:.2f}"), r


@pytest.mark.parametrize("url,depth,section", [("/", 0, ""), ("x", 0, "x"), ("/a/b/", 2, "a"), ("http://h/p", 3, ""), ("/a//", 1, "a")])
def test_url_parts(spark, url, depth, section):
    row = spark.createDataFrame([(url,)], "u string").selectExpr(fn.url_depth("u"), fn.url_section("u")).first()
    assert tuple(row) == (depth, section)


def test_epoch_micros_ignores_the_session_time_zone(spark):
    row = spark.sql("select timestamp_ntz'2024-03-10 02:30:00.123456' t, timestamp_ntz'1969-12-31 23:59:59.5' u")
    assert tuple(row.select(fn.epoch_micros(F.col("t")), fn.epoch_micros(F.col("u"))).first()) == (1710037800123456, -500000)


# --- detectors -------------------------------------------------------------------------------------

def test_rules(scored):
    rows = scored.collect()
    assert all(0 <= r["statistical_score"] <= 1 for r in rows)
    for r in rows:
        if r["traffic_class"] == "simple_bot":
            assert r["statistical_score"] == 0.97 and "bot user-agent detected: python-requests" in r["statistical_reason"]
    fired = {r["traffic_class"]: r["statistical_reason"] for r in rows}
    assert "iat_cv=" in fired["llm_agent"] and "session_depth=" in fired["human"]


def test_clean_session_has_no_reason(spark, features):
    calm = features.limit(1).withColumns({
        "http_rpm_mean": F.lit(5.0), "http_iat_cv": F.lit(1.0), "http_rate_404": F.lit(0.15), "http_has_sec_fetch": F.lit(1.0),
        "user_agent": F.lit("Mozilla"), "http_session_depth": F.lit(50.0), "http_burst_ratio": F.lit(0.5)})
    row = detectors.with_rules(calm).first()
    assert (row["statistical_score"], row["statistical_reason"]) == (0.0, "CLEAN")
    warned = detectors.with_rules(calm.withColumns({"http_rpm_mean": F.lit(90.5), "http_rate_404": F.lit(0.2)})).first()
    assert warned["statistical_score"] == 0.7
    assert warned["statistical_reason"] == "rpm=90 (warn threshold 60.0) | 404_rate=0.20"


@pytest.mark.parametrize("n,confidence", [(2, "INSUFFICIENT_DATA"), (3, "LOW"), (10, "MEDIUM"), (30, "HIGH")])
def test_agent_confidence(features, n, confidence):
    row = detectors.with_agent_score(features.limit(1).withColumn("n_requests", F.lit(n))).first()
    assert row["llm_confidence"] == confidence and (n > 2 or row["llm_score"] == 0.0)


def test_agent_scores_are_in_range_and_explained(features):
    scored = detectors.with_agent_score(features)
    assert scored.filter("llm_score < 0 or llm_score > 1").count() == 0
    assert detectors.explain_agent(scored).count() == 7 * scored.count()


def test_agent_scores_above_people(requests, spark):
    means = dict(session_features(requests).groupBy("traffic_class").agg(F.avg("llm_llm_score")).collect())
    assert means["llm_agent"] > 0.4


@pytest.mark.parametrize("scores,risk,firing", [
    ((0.2, 0.1, 0.1, 0.2), 0.145, 0), ((0.97, 0.0, 0.0, 0.0), 0.9215, 1), ((0.6, 0.6, 0.0, 0.0), 0.33, 2),
    ((1.0, 1.0, 1.0, 1.0), 1.0, 4), ((0.5, 0.5, 0.5, 0.5), 0.5, 0)])
def test_ensemble(features, scores, risk, firing):
    names = ("statistical_score", "isolation_score", "gb_score", "llm_score")
    ready = features.limit(1).withColumns({n: F.lit(s) for n, s in zip(names, scores)} | {
        "statistical_reason": F.lit("r" * 60), "llm_confidence": F.lit("LOW")})
    row = detectors.with_ensemble(ready).first()
    assert abs(row["risk_score"] - risk) < 1e-12 and row["n_detectors_firing"] == firing
    assert f"[{'r' * 40}]" in row["explanation"] and row["explanation"].endswith(f"Firing={firing}/4")
    assert set(row["llm_signals"]) == set(detectors.SIGNALS)


# --- decisions -----------------------------------------------------------------------------------------

# risk, action in general, in checkout, and on a login page with stricter context; some lie on a floor
LADDER = [(0.0, "allow", "allow", "allow"), (0.2999, "allow", "allow", "monitor"), (0.30, "monitor", "allow", "monitor"),
          (0.47, "monitor", "monitor", "throttle"), (0.55, "throttle", "monitor", "throttle"), (0.6999, "throttle", "throttle", "challenge"),
          (0.70, "challenge", "throttle", "challenge"), (0.8499, "challenge", "challenge", "block"), (0.85, "block", "challenge", "block"),
          (1.0, "block", "block", "block")]


@pytest.fixture
def ladder(spark):
    rows = [(f"s{k}", step[0], f"signals {k}", ["AS8075", "AS64500", None][k % 3]) for k, step in enumerate(LADDER)]
    return spark.createDataFrame(rows, "session_id string, risk_score double, explanation string, asn string").repartition(3)


def by_session(decided):
    return [r for r in sorted(decided.collect(), key=lambda r: r["session_id"])]


def test_actions_and_parameters(ladder):
    rows = by_session(mitigation.decide(ladder))
    assert [r["action"] for r in rows] == [step[1] for step in LADDER]
    for k, r in enumerate(rows):
        assert r["reason"] == ("clean traffic" if r["action"] == "allow" else f"signals {k}")
        assert r["delay_ms"] == (2000 if r["action"] == "throttle" else 0)
        assert r["block_ttl_s"] == (3600 if r["action"] == "block" else 0)
        assert r["challenge_type"] == ("js_proof_of_work" if r["action"] == "challenge" else None)
    counted = {r["action"]: r["n_decisions"] for r in mitigation.action_summary(mitigation.decide(ladder)).collect()}
    assert counted == {"allow": 2, "monitor": 2, "throttle": 2, "challenge": 2, "block": 2}


def test_context_and_allow_list(ladder):
    assert [r["action"] for r in by_session(mitigation.decide(ladder, context="checkout"))] == [step[2] for step in LADDER]
    strict = Settings(mitigation=MitigationSettings(stricter_context=True))
    assert [r["action"] for r in by_session(mitigation.decide(ladder, strict, context="login"))] == [step[3] for step in LADDER]
    plain = mitigation.decide(ladder)
    assert [r["action"] for r in by_session(mitigation.decide(ladder, context="nowhere"))] == [r["action"] for r in by_session(plain)]
    for k, r in enumerate(by_session(mitigation.decide(ladder, allow_list=True))):
        assert (r["action"], r["reason"]) == ("allow", "allowlisted IP/ASN") or k % 3 and r["action"] == LADDER[k][1]


def test_repeat_offenders_with_hot_addresses(spark, small_scale):
    rows = [(f"10.0.0.{i % 3 if i % 2 else 0}", float(i // 2), f"s{i:03}", "block", 0.9) for i in range(200)]
    decided = spark.createDataFrame(rows, "ip string, end_ms double, session_id string, action string, risk_score double")
    plain = sorted(map(tuple, mitigation.repeat_offenders(decided).collect()))
    assert sorted(map(tuple, mitigation.repeat_offenders(decided, small_scale).collect())) == plain
    for ip, at, sid, earlier in plain:
        assert earlier == sum(r[0] == ip and (r[1], r[2]) < (at, sid) for r in rows)


# --- evaluation ------------------------------------------------------------------------------------------

def test_report_of_separable_scores(spark):
    """Ties inside a class, unequal classes, and a score on the threshold itself."""
    labels, scores = [1] * 4 + [0] * 9, [0.5, 0.75, 0.75, 0.99] + [0.49, 0.49, 0.2, 0.2, 0.2, 0.0, 0.0, 0.31, 0.07]
    data = frame(spark, labels, scores)
    row = evaluation.full_report(data, 0.5).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (4, 0, 9, 0) and (row["auroc"], row["auprc"]) == (1.0, 1.0)
    higher = evaluation.full_report(data, 0.75).first()
    assert (higher["tp"], higher["fn"], higher["recall"], higher["precision"]) == (3, 1, 0.75, 1.0)
    given = evaluation.confusion_metrics(data.withColumn("guess", (F.col("y_score") < 0.3).cast("int")), prediction="guess").first()
    assert (given["tp"], given["fp"], given["tn"], given["fn"]) == (0, 6, 3, 4)


@pytest.mark.parametrize("seed,digits", [(0, 9), (1, 1), (2, 2)])
def test_areas_equal_loops(spark, seed, digits):
    random.seed(seed)
    labels = [int(random.random() < 0.4) for _ in range(300)]
    scores = [round(random.random() * 0.7 + 0.3 * y, digits) for y in labels]
    data = frame(spark, labels, scores).repartition(5)
    points = evaluation.curve_points(data)
    assert abs(evaluation.auroc(data, points).first()[0] - brute.auroc(labels, scores)) < 1e-9
    assert abs(evaluation.auprc(data, points).first()[0] - brute.auprc(labels, scores)) < 1e-9
    for r in evaluation.roc_curve(data, points).collect():
        hit = [y for y, s in zip(labels, scores) if s >= r["threshold"]]
        assert (r["tp"], r["fp"]) == (sum(hit), len(hit) - sum(hit))


def test_one_class_only(spark):
    assert evaluation.auroc(frame(spark, [1, 1], [0.2, 0.8])).first()[0] == 1.0
    assert evaluation.auroc(frame(spark, [0, 0], [0.2, 0.8])).first()[0] == 0.0


@pytest.mark.parametrize("sizes,overlap", [((130, 61), 0.15), ((40, 350), 0.0), ((411, 97), 0.35)])
def test_optimal_threshold_equals_loops(spark, sizes, overlap):
    draw = random.Random(sizes[0])
    low = [draw.betavariate(2, 6) * (0.6 + overlap) for _ in range(sizes[0])]
    # every third attack score lies on a cut point
    high = [evaluation.THRESHOLDS[draw.randrange(30, 90)] if k % 3 == 0 else 0.35 + 0.65 * draw.random() for k in range(sizes[1])]
    allowed = {}
    for cut in evaluation.THRESHOLDS:
        fpr, recall = (round(sum(s >= cut for s in side) / len(side), 4) for side in (low, high))
        if fpr <= 0.02 and recall > 0:
            allowed[cut] = (recall, fpr)
    cut = min(allowed, key=lambda c: (-allowed[c][0], c))
    row = evaluation.optimal_threshold(frame(spark, [0] * len(low) + [1] * len(high), low + high), 0.02).first()
    assert (row["threshold"], row["recall"], row["fpr"]) == (cut, *allowed[cut])


def test_optimal_threshold_falls_back(spark):
    assert evaluation.optimal_threshold(frame(spark, [0, 1], [1.0, 0.05])).first()["threshold"] == 0.5


def test_per_class(spark):
    labels, scores = [0] * 8 + [1] * 3, [0.0, 0.2, 0.49, 0.5, 0.51, 0.1, 0.3, 0.9, 0.5, 0.4, 0.0]
    rows = {r["traffic_class"]: r for r in evaluation.per_class_metrics(frame(spark, labels, scores)).collect()}
    people, agents = rows["human"], rows["llm_agent"]
    assert (people["n"], people["false_positives"], people["correctly_allowed"], people["fpr"], people["recall"]) == (8, 3, 5, 0.375, None)
    assert (agents["n"], agents["detected"], agents["missed"], agents["recall"], agents["fpr"]) == (3, 1, 2, 0.3333, None)


def test_metric_flags(spark):
    rows = spark.createDataFrame([(0.03, 0.95), (0.02, 0.5)], "fpr double, recall double")
    assert [(r["fpr_flag"], r["recall_flag"]) for r in evaluation.metric_flags(rows).collect()] == [("HIGH", "OK"), ("OK", "LOW")]


def test_rank_limits_apply_before_the_shuffle(requests, features):
    for job in (extras.first_n_per_class(features, 2), extras.url_entropy_recent(requests)):
        assert "WindowGroupLimit" in job._jdf.queryExecution().executedPlan().toString()
