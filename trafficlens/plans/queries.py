"""The query catalog: one callable (spark, folder) -> DataFrame per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT
from trafficlens.functions import columns as fn
from trafficlens.operators import detectors as det
from trafficlens.operators import evaluation as ev
from trafficlens.operators import extras, mitigation, models, networks, sequence
from trafficlens.operators.features import (FAMILIES, FEATURE_NAMES, clean_features, family_features,
                                            session_features)
from trafficlens.operators.skew import materialize, new_path, number_rows, shared_dir
from trafficlens.plans import scoring
from trafficlens.sources import http_text, store
from trafficlens.sources import requests as req
from trafficlens.streaming import blocks, sessions, windows

Query = Callable[[SparkSession, str], DataFrame]
tidy = fn.tidy


def requests(spark: SparkSession, folder: str) -> DataFrame:
    return req.requests_from_events(req.read_events(spark, folder))


def scored(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.score(session_features(requests(spark, folder)))


def judged(spark: SparkSession, folder: str) -> DataFrame:
    return scoring.eval_input(scored(spark, folder), "statistical_score")


def _as_int(*names: str) -> list[Column]:
    return [F.col(n).cast("int").alias(n) for n in names]


def _family(name: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = family_features(requests(spark, folder), name)
        return found.select("session_id", *[tidy(F.col(c)).alias(c) for c in FAMILIES[name].names])
    return run


# --- sources --------------------------------------------------------------------------------------

def request_log(spark: SparkSession, folder: str) -> DataFrame:
    log = req.request_log(requests(spark, folder))
    return (log.withColumn("timestamp_ms", F.col("timestamp_ms").cast("bigint"))
            .withColumn("is_api", F.col("is_api").cast("int"))
            .withColumn("has_referrer", F.col("has_referrer").cast("int")))


def session_summary(spark: SparkSession, folder: str) -> DataFrame:
    found = req.session_summary(requests(spark, folder))
    return (found.withColumn("duration_ms", F.col("duration_ms").cast("bigint"))
            .withColumn("start_time_ms", F.col("start_time_ms").cast("bigint")))


def nested_sessions(spark: SparkSession, folder: str) -> DataFrame:
    nested = req.nested_sessions(requests(spark, folder), 7)
    return nested.select("session_id", "part_no", "n_requests", F.array_join("requests.url", " ").alias("urls"))


def _text_folder(spark: SparkSession, folder: str, body: bool = False) -> str:
    """The request log rendered as the three labelled text files, in the shared folder."""
    rows = requests(spark, folder)
    rendered = http_text.render_blocks(rows)  # stored once below: three files are written from it
    if body:
        # a blank line before the body makes it a block of its own
        text = F.when(F.col("method") == "POST", F.concat("block", F.lit("\nX-Id: "), "request_id", F.lit("\n\nid="), "request_id"))
        rendered = rendered.withColumn("block", text.otherwise(F.concat("block", F.lit("\nX-Id: "), "request_id")))
    rendered = materialize(rendered.select("block", "label", "method"), "rendered")
    out = new_path(spark, "http-text")
    settings = http_text.DEFAULT.http_text
    parts = {settings.normal_train_file: "label = 0 and method = 'GET'",
             settings.normal_test_file: "label = 0 and method = 'POST'",
             settings.anomalous_file: "label = 1"}
    for name, condition in parts.items():
        rendered.filter(condition).select("block").write.option("lineSep", "\n\n").text(f"{out}/{name}")
    return out


def http_parse(spark: SparkSession, folder: str) -> DataFrame:
    rendered = http_text.render_blocks(requests(spark, folder)).select("request_id", "block")
    return http_text.parse_blocks(rendered).select(
        "request_id", "method", "url", "version", "user_agent",
        F.try_element_at("headers", F.lit("host")).alias("host"), "body")


def http_blocks(spark: SparkSession, folder: str) -> DataFrame:
    text = _text_folder(spark, folder)
    parsed = http_text.parse_blocks(http_text.read_blocks(spark, f"{text}/*"))
    return parsed.groupBy("method", "url", "user_agent").agg(F.count(F.lit(1)).alias("n_blocks"))


def http_normalize(spark: SparkSession, folder: str) -> DataFrame:
    text = _text_folder(spark, folder)
    loaded = http_text.load_labelled(spark, text)
    return (loaded.withColumn("is_api", F.col("is_api").cast("int"))
            .groupBy("method", "url", "user_agent", "label", "status_code", "is_api", "request_size_bytes", "response_size_bytes", "response_time_ms")
            .agg(F.count(F.lit(1)).alias("n_requests")))


def http_load_labelled(spark: SparkSession, folder: str) -> DataFrame:
    text = _text_folder(spark, folder)
    return (http_text.load_labelled(spark, text).groupBy("label", "method", "user_agent")
            .agg(F.count(F.lit(1)).alias("n_requests")))


def attach_body(spark: SparkSession, folder: str) -> DataFrame:
    text = _text_folder(spark, folder, body=True)
    joined = http_text.attach_bodies(http_text.read_blocks(spark, f"{text}/*"))
    return http_text.parse_blocks(joined).select(
        "method", "url", "body", F.try_element_at("headers", F.lit("x-id")).cast("bigint").alias("request_id"))


def pseudo_sessions(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder).select("request_id", "label", "user_agent")
    found = http_text.labelled_sessions(http_text.numbered_by_label(rows, [F.col("request_id")]), 20, 42)
    return found.select(
        "session_id", "ip", "row_no", "position", "label", "traffic_class", "session_agent",
        F.col("start_time_ms").cast("bigint").alias("start_time_ms"), tidy(F.col("offset_ms"), 3).alias("offset_ms"))


def cap_requests(spark: SparkSession, folder: str) -> DataFrame:
    numbered = http_text.numbered_by_label(requests(spark, folder).select("request_id", "label"), [F.col("request_id")])
    parts = [http_text.cap_requests(numbered.filter(F.col("label") == x), 50, 20) for x in (0, 1)]
    return parts[0].unionByName(parts[1]).select("label", "request_id", "row_no")


# --- projections, joins, sets -------------------------------------------------------------------------

def _attack_texts(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return (documents.select(F.lit("document").alias("source"), F.col("doc_id").alias("id"), "text")
            .unionByName(pages.select(F.lit("page").alias("source"), F.col("page_id").alias("id"),
                                      F.concat_ws(" ", "url", "html").alias("text"))))


def attack_type(spark: SparkSession, folder: str) -> DataFrame:
    return http_text.with_attack_type(_attack_texts(spark, folder), F.col("text")).select("source", "id", "attack_type")


def attack_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    return http_text.attack_breakdown(_attack_texts(spark, folder), F.col("text"))


def bot_ua(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("request_id", fn.is_bot_agent(F.col("user_agent")).cast("int").alias("is_bot_agent"))


def label_map(spark: SparkSession, folder: str) -> DataFrame:
    cls = F.col("traffic_class")
    return (requests(spark, folder).select("session_id", "traffic_class").distinct()
            .select("*", fn.class_label(cls).alias("y_multi"), fn.binary_label(cls).alias("y_binary")))


def feature_clean(spark: SparkSession, folder: str) -> DataFrame:
    odd = F.expr("""case status_code when 404 then double('NaN') when 500 then double('Infinity')
                    when 401 then double('-Infinity') else double(response_size_bytes) end""")
    return clean_features(requests(spark, folder).select("request_id", odd.alias("value")), ["value"])


def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = requests(spark, folder).select("session_id", "label")
    normal = rows.filter("label = 0").withColumn("source", F.lit("normal"))
    attack = rows.filter("label = 1").withColumn("source", F.lit("attack"))
    return normal.unionByName(attack).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n_requests"))


def distinct_pages(spark: SparkSession, folder: str) -> DataFrame:
    return requests(spark, folder).select("session_id", "url").distinct()


def class_distribution(spark: SparkSession, folder: str) -> DataFrame:
    sessions = req.session_summary(requests(spark, folder))
    return sessions.groupBy("traffic_class").agg(F.count(F.lit(1)).alias("n_sessions"))


def first_n_per_class(spark: SparkSession, folder: str) -> DataFrame:
    sessions = req.session_summary(requests(spark, folder)).withColumnRenamed("start_time_ms", "start_ms")
    return extras.first_n_per_class(sessions, 2).select(
        "traffic_class", "session_id", F.col("rank").cast("bigint").alias("rank"))


# --- sequence and features ------------------------------------------------------------------------------

def iat(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.gaps(requests(spark, folder)).withColumn("gap_ms", tidy(F.col("gap_ms")))


def backtracks(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.url_steps(requests(spark, folder)).select(
        "session_id", "request_id", "seq", *_as_int("is_backtrack"))


def forward_steps(spark: SparkSession, folder: str) -> DataFrame:
    return sequence.url_steps(requests(spark, folder)).select(
        "session_id", "request_id", "seq", *_as_int("is_forward"))


def all_features(spark: SparkSession, folder: str) -> DataFrame:
    return session_features(requests(spark, folder)).select(
        "session_id", "traffic_class", "label", "user_agent",
        *[F.expr(f"round({c}, 6) + 0D as {c}") for c in FEATURE_NAMES])


def feature_matrix(spark: SparkSession, folder: str) -> DataFrame:
    matrix = models.feature_matrix(session_features(requests(spark, folder)))
    values = matrix.withColumn("v", vector_to_array("features"))
    slots = [F.expr(f"round(v[{k}], 6) + 0D as {name}") for k, name in enumerate(FEATURE_NAMES)]
    return values.select("session_id", "y_binary", "y_multi", F.size("v").alias("n_features"), *slots)


# --- detectors -----------------------------------------------------------------------------------------------

def stat_rules(spark: SparkSession, folder: str) -> DataFrame:
    rules = det.with_rules(session_features(requests(spark, folder)))
    return rules.select("session_id", *[tidy(F.col(f"rule_{r}")).alias(f"rule_{r}") for r in det.RULES])


def _rules(*columns: str) -> Query:
    return lambda spark, folder: det.with_rules(session_features(requests(spark, folder))).select(*columns)


def stat_predict(spark: SparkSession, folder: str) -> DataFrame:
    return det.predict(_rules("session_id", "statistical_score")(spark, folder), "statistical_score").drop("statistical_score")


def _agent(spark: SparkSession, folder: str) -> DataFrame:
    return det.with_agent_score(session_features(requests(spark, folder)))


def llm_detector(spark: SparkSession, folder: str) -> DataFrame:
    return _agent(spark, folder).select("session_id", "llm_score", "llm_confidence")


def llm_predict(spark: SparkSession, folder: str) -> DataFrame:
    return det.predict(_agent(spark, folder), "llm_score").select("session_id", "prediction")


def llm_explain(spark: SparkSession, folder: str) -> DataFrame:
    return det.explain_agent(_agent(spark, folder)).select(
        "session_id", "signal", tidy(F.col("value")).alias("value"), *_as_int("is_high"), "verdict")


def ensemble_no_ml(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("session_id", "statistical_score", "llm_score", "n_detectors_firing",
                                        tidy(F.col("risk_score")).alias("risk_score"))


def ensemble_explain(spark: SparkSession, folder: str) -> DataFrame:
    return scored(spark, folder).select("session_id", "explanation")


# --- mitigation ---------------------------------------------------------------------------------------------

def _decision(decided: DataFrame) -> DataFrame:
    return decided.select("session_id", tidy(F.col("risk_score")).alias("risk_score"), "page_context", "action",
                          "reason", "delay_ms", "block_ttl_s", "challenge_type")


def decide(spark: SparkSession, folder: str) -> DataFrame:
    return _decision(mitigation.decide(scored(spark, folder)))


def decide_context(spark: SparkSession, folder: str) -> DataFrame:
    return _decision(mitigation.decide_in_context(scored(spark, folder)))


def allowlist(spark: SparkSession, folder: str) -> DataFrame:
    return _decision(mitigation.decide(scored(spark, folder), allow_list=True))


def allowlist_join(spark: SparkSession, folder: str) -> DataFrame:
    sessions = requests(spark, folder).groupBy("session_id").agg(F.max("asn").alias("asn"))
    table = spark.createDataFrame([(a,) for a in mitigation.DEFAULT.mitigation.allowed_asns], "asn string")
    return mitigation.allowed_by_table(sessions, table).select("session_id", "asn", *_as_int("is_allowed"))


def allowlist_cidr(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions whose address is in a network of a table: networks and single addresses, some inside others."""
    nations = spark.read.parquet(f"{folder}/nation.parquet")
    host = "concat('10.0.', n_nationkey, '.', n_regionkey * 4)"
    listed = nations.selectExpr(f"explode(array(concat({host}, '/', 28 + n_regionkey % 3), concat('10.0.', n_nationkey, '.', n_regionkey * 4 + 1), concat({host}, '/30'))) as cidr")
    sessions_ip = requests(spark, folder).groupBy("session_id").agg(F.max("ip").alias("ip"))
    return networks.in_networks(sessions_ip, networks.network_ranges(listed)).select("session_id", "ip", *_as_int("is_allowed"))


def action_summary(spark: SparkSession, folder: str) -> DataFrame:
    return mitigation.action_summary(mitigation.decide_in_context(scored(spark, folder)))


def _stored_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions as a table: jobs over the history of decisions read it, not the requests."""
    decided = mitigation.decide(scored(spark, folder))
    return materialize(decided.select("session_id", "ip", "end_ms", "action", "risk_score"), "decisions")


def repeat_offenders(spark: SparkSession, folder: str) -> DataFrame:
    return mitigation.repeat_offenders(_stored_decisions(spark, folder)).select("ip", "session_id", "earlier_blocks")


def block_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.block_intervals(_stored_decisions(spark, folder))


def known_ja3(spark: SparkSession, folder: str) -> DataFrame:
    return mitigation.known_ja3(requests(spark, folder)).select("request_id", "ja3")


def unknown_ja3(spark: SparkSession, folder: str) -> DataFrame:
    return mitigation.known_ja3(requests(spark, folder), keep_known=False).select("request_id", "ja3")


# --- evaluation -----------------------------------------------------------------------------------------------

def scores_by_class(spark: SparkSession, folder: str) -> DataFrame:
    means = ev.scores_by_class(scored(spark, folder))
    return means.select("traffic_class", *[tidy(F.col(c)).alias(c) for c in means.columns if c != "traffic_class"])


def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return ev.confusion_metrics(judged(spark, folder))


def metric_flags(spark: SparkSession, folder: str) -> DataFrame:
    return ev.metric_flags(ev.confusion_metrics(judged(spark, folder)))


def per_class_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return ev.per_class_metrics(judged(spark, folder))


def roc_curve(spark: SparkSession, folder: str) -> DataFrame:
    return ev.roc_curve(judged(spark, folder)).withColumns({c: tidy(F.col(c)) for c in ("tpr", "fpr")})


def pr_curve(spark: SparkSession, folder: str) -> DataFrame:
    return ev.pr_curve(judged(spark, folder)).withColumns({c: tidy(F.col(c)) for c in ("precision", "recall")})


def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return ev.auroc(judged(spark, folder)).select(tidy(F.col("auroc")).alias("auroc"))


def auprc(spark: SparkSession, folder: str) -> DataFrame:
    return ev.auprc(judged(spark, folder)).select(tidy(F.col("auprc")).alias("auprc"))


def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return ev.threshold_grid(judged(spark, folder)).withColumn("threshold", tidy(F.col("threshold")))


def optimal_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return ev.optimal_threshold(judged(spark, folder)).select(tidy(F.col("threshold")).alias("threshold"), "recall", "fpr")


# --- windows and extras -------------------------------------------------------------------------------------------

def sessionize_gap(spark: SparkSession, folder: str) -> DataFrame:
    events = req.read_events(spark, folder).select(
        F.col("user_id").cast("string").alias("user_key"), F.col("event_id").alias("request_id"),
        (fn.epoch_micros(F.col("ts")) / 1000.0).alias("timestamp_ms"))
    found = extras.sessionize_gap(events, key="user_key")
    return found.select("user_key", "session_no", "n_requests",
                        tidy((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_s"))


def _int_flag(frame: DataFrame, name: str) -> DataFrame:
    return frame.withColumn(name, F.col(name).cast("int"))


def rpm_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    return _int_flag(extras.rpm_windows(requests(spark, folder)), "over_limit")


def rpm_sliding(spark: SparkSession, folder: str) -> DataFrame:
    return _int_flag(extras.rpm_windows(requests(spark, folder), length="5 minutes", slide="1 minute"), "over_limit")


def iat_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return extras.iat_histogram(requests(spark, folder))


def url_entropy_last50(spark: SparkSession, folder: str) -> DataFrame:
    return extras.url_entropy_recent(requests(spark, folder)).withColumn("url_entropy", tidy(F.col("url_entropy")))


def missing_headers(spark: SparkSession, folder: str) -> DataFrame:
    return extras.missing_headers(requests(spark, folder))


def rpm_zscore(spark: SparkSession, folder: str) -> DataFrame:
    found = extras.rpm_zscore(requests(spark, folder))
    return _int_flag(found.withColumn("rpm", tidy(F.col("rpm"))).withColumn("zscore", tidy(F.col("zscore"))), "is_outlier")


def consecutive_404s(spark: SparkSession, folder: str) -> DataFrame:
    return _int_flag(extras.consecutive_404s(requests(spark, folder)), "too_many")


def timing_flag(spark: SparkSession, folder: str) -> DataFrame:
    return extras.timing_flag(requests(spark, folder)).select("session_id", *_as_int("is_regular"))


def regular_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _int_flag(extras.regular_runs(requests(spark, folder)), "is_regular")


def peak_rpm(spark: SparkSession, folder: str) -> DataFrame:
    return extras.peak_rpm(requests(spark, folder))


def distinct_pages_by_days(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct urls of every session over all days and over the first 30, from sketches of single days.

    The view's requests lie within minutes; a hundred thousand times further apart, they fall on many days.
    """
    apart = F.lit(1.7e12) + (F.col("timestamp_ms") - 1.7e12) * 100_000
    sketches = materialize(extras.day_sketches(requests(spark, folder).withColumn("timestamp_ms", apart), ["session_id"], "url"), "sketches")
    first = int(1.7e12 // extras.DAY_MS)
    whole = extras.distinct_over_days(sketches, ["session_id"])
    early = extras.distinct_over_days(sketches, ["session_id"], first, first + 29).withColumnRenamed("n_distinct", "n_early")
    return whole.join(early, "session_id", "left").select("session_id", "n_distinct", F.coalesce("n_early", F.lit(0)).alias("n_early"))


def features_of_store(spark: SparkSession, folder: str) -> DataFrame:
    """All features from the request table that is stored by session, without an exchange."""
    stored = store.write_store(requests(spark, folder), f"requests_{uuid.uuid4().hex}", 8, new_path(spark, "store"))
    return session_features(stored).select("session_id", *[tidy(F.col(c)).alias(c) for c in FEATURE_NAMES])


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    timed = windows.with_event_time(windows.event_stream(spark, folder))
    closed = windows.run_to_end(windows.closed_sessions(timed, "user_id"), "stream-sessions")
    done = windows.with_open_sessions(closed, windows.event_rows(spark, folder), "user_id")
    return done.select(F.col("user_id").cast("string").alias("user_key"), "n_requests", "start_ms", "end_ms")


def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    timed = windows.with_event_time(windows.event_stream(spark, folder))
    done = windows.run_to_end(windows.rates(timed, "user_id"), "stream-rates")
    return _int_flag(windows.with_open_windows(done, windows.event_rows(spark, folder), "user_id"), "over_limit")


# --- models: SQL knows the sessions and what must hold of their scores -------------------------------------------------------------------------------------

def _fit(spark: SparkSession, folder: str) -> tuple[scoring.Detectors, DataFrame]:
    """Detectors and the held-out part. The first query of an application that needs them fits and saves; the others load."""
    train, test = models.train_test_split(session_features(requests(spark, folder)))
    name = folder.rstrip("/").rpartition("/")[2]
    path = f"{shared_dir(spark)}/trafficlens/{spark.sparkContext.applicationId}/catalog-models-{name}"
    if not scoring.saved_at(spark, path):
        scoring.fit_detectors(train).save(spark, path)
    return scoring.Detectors.load(spark, path), test


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _in_range(name: str) -> list[Column]:
    return [_flag(F.col(name).between(0.0, 1.0)).alias(f"{name}_in_range")]


def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = models.train_test_split(session_features(requests(spark, folder)).select("session_id", "label"))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


def seeded_order(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every session in the seeded order."""
    sessions = req.session_summary(requests(spark, folder)).select("session_id", "label")
    return number_rows(sessions, models.seeded_keys("session_id"), "order")


def scale_features(spark: SparkSession, folder: str) -> DataFrame:
    matrix = models.feature_matrix(session_features(requests(spark, folder)))
    fitted = models.scaler().fit(matrix)
    scaled = fitted.transform(matrix).withColumn("v", vector_to_array("scaled"))
    return scaled.select("session_id", *[F.expr(f"round(v[{k}], 4) + 0D as {name}") for k, name in enumerate(FEATURE_NAMES)])


def _forest_scored(spark: SparkSession, folder: str) -> DataFrame:
    train, test = models.train_test_split(session_features(requests(spark, folder)))
    return models.with_forest(test, models.fit_forest(train))


def iforest(spark: SparkSession, folder: str) -> DataFrame:
    return _forest_scored(spark, folder).select(
        "session_id", "label", *_in_range("isolation_score"),
        _flag(F.col("isolation_prediction") == (F.col("isolation_score") > 0.5).cast("int")).alias("prediction_fits"))


def iforest_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _forest_scored(spark, folder).select("session_id", "label", "isolation_score", "isolation_prediction")


def gbt(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out sessions with the predicted label."""
    fitted, test = _fit(spark, folder)
    return models.with_boosting(test, fitted.boosting).select(
        "session_id", "label", "gb_prediction", *_in_range("gb_score"), _flag(F.col("gb_prediction") == (F.col("gb_score") > 0.5).cast("int")).alias("prediction_fits"))


def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    fitted, test = _fit(spark, folder)
    return models.with_boosting(test, fitted.boosting).select("session_id", "label", "gb_score", "gb_prediction")


def top_features(spark: SparkSession, folder: str) -> DataFrame:
    """Fifteen features of the vector, none twice, importance not rising."""
    found = models.top_features(spark, _fit(spark, folder)[0].boosting)
    order = Window.orderBy(F.desc("importance"), "feature")  # fifteen rows
    return found.select(F.row_number().over(order).alias("rank"), _flag(F.col("feature").isin(*FEATURE_NAMES)).alias("is_feature"),
                        _flag(F.count(F.lit(1)).over(Window.partitionBy("feature")) == 1).alias("is_single"),
                        *_in_range("importance"))


def feature_importances(spark: SparkSession, folder: str) -> DataFrame:
    """All features with their share of the gain, the largest first."""
    return models.top_features(spark, _fit(spark, folder)[0].boosting, len(FEATURE_NAMES))


def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the held-out sessions by saved and loaded models."""
    fitted, test = _fit(spark, folder)
    path = new_path(spark, "models")
    fitted.save(spark, path)
    loaded = scoring.Detectors.load(spark, path)
    before = scoring.score(test, fitted).select("session_id", F.struct("isolation_score", "gb_score", "risk_score").alias("before"))
    after = scoring.score(test, loaded).select("session_id", F.struct("isolation_score", "gb_score", "risk_score").alias("after"))
    return before.join(after, "session_id").select("session_id", _flag(F.col("before") == F.col("after")).alias("is_equal"))


def ensemble(spark: SparkSession, folder: str) -> DataFrame:
    """The risk score against the weighted mean worked out again from the four stored scores."""
    fitted, test = _fit(spark, folder)
    found = scoring.score(test, fitted)
    weights = {"statistical_score": 0.25, "isolation_score": 0.25, "gb_score": 0.30, "llm_score": 0.20}
    mean = reduce(Column.__add__, [F.col(c) * w for c, w in weights.items()])
    most = F.greatest(*weights)
    firing = reduce(Column.__add__, [(F.col(c) > 0.5).cast("int") for c in weights])
    return found.select("session_id", "label", tidy(F.col("statistical_score")).alias("statistical_score"), tidy(F.col("llm_score")).alias("llm_score"),
                        *_in_range("risk_score"), _flag(F.col("risk_score") >= mean - 1e-6).alias("at_least_mean"),
                        _flag((most < 0.95) | (F.col("risk_score") >= 0.85)).alias("override_fits"),
                        _flag(F.col("n_detectors_firing") == firing).alias("firing_fits"), _flag(F.length("explanation") > 0).alias("is_explained"))


def risk_scores(spark: SparkSession, folder: str) -> DataFrame:
    """All layers of the held-out sessions, with the decision."""
    fitted, test = _fit(spark, folder)
    found = materialize(scoring.score(test, fitted), "risk")
    decided = mitigation.decide_in_context(found).select("session_id", "action")
    return found.select("session_id", "label", "statistical_score", "isolation_score", "gb_score", "llm_score", "risk_score", "explanation").join(decided, "session_id")


def risk_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """The best threshold on the risk score of all layers, with its rates."""
    fitted, test = _fit(spark, folder)
    return ev.optimal_threshold(scoring.eval_input(scoring.score(test, fitted)))


def http_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled text files to pseudo-sessions, end to end."""
    rows = http_text.load_sessions(spark, _text_folder(spark, folder))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n_requests"), F.countDistinct("session_id").alias("n_sessions"),
                                     F.max("row_no").alias("last_row"))


def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every session of every address of a stream, scored and decided as it ends, without reading the log again.

    The view's requests lie within minutes; a hundred times further apart, they fall into sessions.
    """
    log = new_path(spark, "log")
    apart = F.lit(1.7e12) + (F.col("timestamp_ms") - 1.7e12) * 100
    requests(spark, folder).withColumn("timestamp_ms", apart).write.parquet(log)
    stored = spark.read.parquet(log)
    found = sessions.score_stream(spark.readStream.schema(stored.schema).parquet(log), "ip")
    scores = found.read(spark, "scores").select("session_id", "n_requests", tidy(F.col("statistical_score")).alias("statistical_score"),
                                                tidy(F.col("llm_score")).alias("llm_score"), tidy(F.col("risk_score")).alias("risk_score"))
    return scores.join(found.read(spark, "decisions").select("session_id", "page_context", "action"), "session_id")


def load_or_fit(spark: SparkSession, folder: str) -> DataFrame:
    """First call fits on the first 60 % and gives the rest; the second loads and gives all."""
    features, path = materialize(session_features(requests(spark, folder)), "load-or-fit"), new_path(spark, "load-or-fit")
    fitted, rest = scoring.load_or_fit(features, path)
    fitted.save(spark, path)
    loaded, whole = scoring.load_or_fit(features, path)
    # the same sessions by the models before and after
    scores = [scoring.score(rest, d).select("session_id", F.col("risk_score").alias(n)) for d, n in ((fitted, "a"), (loaded, "b"))]
    equal = scores[0].join(scores[1], "session_id").select("session_id", _flag(F.col("a") == F.col("b")).alias("same"))
    return (equal.select("session_id", "same", F.lit("fitted").alias("call"))
            .unionByName(whole.select("session_id", F.lit(1).alias("same"), F.lit("loaded").alias("call")))
            .groupBy("call").agg(F.count(F.lit(1)).alias("n_sessions"), F.min("same").alias("same_scores")))


def train_report(spark: SparkSession, folder: str) -> DataFrame:
    """Split, fit, save, score, report: the counts of the report add up to the held-out sessions."""
    report = scoring.train_and_evaluate(requests(spark, folder), new_path(spark, "report"))
    return report.select((F.col("tp") + F.col("fn")).alias("n_attack"), (F.col("fp") + F.col("tn")).alias("n_human"),
                         _flag((F.col("recall") >= 0.8) & (F.col("auroc") >= 0.9)).alias("is_good"), *_in_range("auprc"))


def train_report_full(spark: SparkSession, folder: str) -> DataFrame:
    """The report itself: counts, rates, threshold and areas, and a row for every class."""
    path = new_path(spark, "report")
    whole = scoring.train_and_evaluate(requests(spark, folder), path).withColumn("traffic_class", F.lit("all"))
    return whole.unionByName(spark.read.json(f"{path}/report_per_class"), allowMissingColumns=True)


def best_features_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Boosting on the 30 most important features, and the refusal to train on too few sessions."""
    train, _ = models.train_test_split(session_features(requests(spark, folder)))
    fitted = models.fit_boosting_on_best(train)
    too_few = replace(DEFAULT, models=replace(DEFAULT.models, min_training_sessions=train.count() + 1))
    try:
        models.fit_boosting(train, too_few)
        refused = 0
    except ValueError:
        refused = 1
    rows = list(fitted.importances().items())
    found = spark.createDataFrame(rows, "feature string, importance double")
    return found.groupBy().agg(F.countDistinct("feature").cast("int").alias("n_features"), _flag(F.min(F.col("feature").isin(*FEATURE_NAMES))).alias("are_features"),
                               _flag(F.abs(F.sum("importance") - 1) < 1e-9).alias("shares_add_up"), F.lit(refused).alias("refuses_few"))


def live_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Block registry over the stream of stored decisions: the latest row of every address."""
    store = new_path(spark, "decision-stream")
    decided = mitigation.decide(scored(spark, folder)).select("session_id", "ip", "end_ms", "action")
    decided.write.parquet(store)
    out = new_path(spark, "live-blocks")
    blocks.use_state_store(spark)
    stream = spark.readStream.schema(decided.schema).parquet(store)
    windows.run_batches(blocks.live_blocks(stream),
                        lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), "blocks", "update")
    return spark.read.schema(f"{blocks.BLOCK_SCHEMA}, batch bigint").parquet(out).groupBy("ip").agg(
        F.max_by(F.struct("blocked_from_ms", "blocked_until_ms", "n_blocks"), "batch").alias("b")).select("ip", "b.*")


MODELS = {f.__name__: f for f in (train_test_split, seeded_order, scale_features, iforest, gbt, top_features,
                                  model_roundtrip, ensemble)}
# values that only a fitted model knows: tests compare them with loops
VALUES = {f.__name__: f for f in (iforest_scores, gbt_scores, feature_importances, risk_scores, risk_threshold, train_report_full)}

CHECKED = {name: _family(name) for name in FAMILIES} | {
    f.__name__: f for f in (
        request_log, session_summary, nested_sessions, http_parse, http_blocks, http_normalize, http_load_labelled,
        attach_body, pseudo_sessions, cap_requests, attack_type, attack_breakdown, bot_ua, label_map, feature_clean,
        union_sources, distinct_pages, class_distribution, first_n_per_class, iat, backtracks, forward_steps,
        feature_matrix, stat_rules, stat_predict, llm_detector, llm_predict, llm_explain, ensemble_no_ml,
        ensemble_explain, decide, decide_context, allowlist, allowlist_join, allowlist_cidr, distinct_pages_by_days, features_of_store, action_summary, repeat_offenders,
        block_intervals, known_ja3, unknown_ja3, scores_by_class, confusion_metrics, metric_flags, per_class_metrics,
        roc_curve, pr_curve, auroc, auprc, threshold_grid, optimal_threshold, sessionize_gap, rpm_tumbling,
        rpm_sliding, iat_histogram, url_entropy_last50, missing_headers, rpm_zscore, consecutive_404s, timing_flag,
        regular_runs, peak_rpm, stream_sessions, stream_rates, live_blocks, http_sessions, stream_scores, load_or_fit,
        train_report, best_features_fit)} | {
    "session_features": all_features,
    "stat_score": _rules("session_id", "statistical_score"),
    "stat_reason": _rules("session_id", "statistical_reason"),
}

QUERIES: dict[str, Query] = CHECKED | MODELS | VALUES
