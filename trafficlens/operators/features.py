"""The 51 session features.

Every feature is a formula over measures, and every measure is a sum, minimum or maximum. Measures
merge, so grouping can go through levels: (session, url) for distinct pages and url entropy,
(session, section) for sections, then session. With ordinary sessions all levels reuse the hash
partitioning of the window, so the whole job has one shuffle; with a hot session each level
pre-aggregates before its own shuffle.

A family builds only what it needs: no window when no order is asked for, no url level when
nothing counts urls.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.config import BOT_AGENT_WORDS, DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.sequence import (IS_BACKTRACK, IS_FORWARD, split_sessions,
                                            with_history)


@dataclass(frozen=True)
class Family:
    """Features of one query and what their measures need."""

    names: tuple[str, ...]
    order: bool = False
    urls: bool = False
    sections: bool = False
    endpoints: bool = False
    picks: bool = False  # a first or last value, or a deviation of a size
    steps: bool = False  # earlier urls


# Feature names by family, in the order of the feature vector.
FAMILIES = {
    "http_timing": Family(("http_iat_mean_ms", "http_iat_std_ms", "http_iat_cv",
                           "http_iat_min_ms", "http_iat_max_ms"), order=True),
    "http_rate": Family(("http_rpm_mean", "http_burst_ratio", "http_session_depth",
                         "http_session_duration_s"), order=True),
    "http_status_rates": Family(("http_error_rate", "http_rate_4xx", "http_rate_404",
                                 "http_rate_5xx")),
    "http_url_diversity": Family(("http_unique_url_ratio", "http_api_ratio", "http_depth_max",
                                  "http_depth_mean"), urls=True),
    "http_url_entropy": Family(("http_url_entropy",), urls=True),
    "http_headers": Family(("http_header_completeness", "http_has_sec_fetch",
                            "http_has_sec_ch_ua", "http_has_accept_language",
                            "http_header_mean_count")),
    "http_methods": Family(("http_post_ratio", "http_get_ratio")),
    "http_payload": Family(("http_req_size_mean", "http_resp_size_mean", "http_resp_size_cv",
                            "http_referrer_ratio"), picks=True),
    "beh_navigation": Family(("beh_revisit_ratio", "beh_backtrack_rate", "beh_n_unique_pages"),
                             order=True, urls=True, steps=True),
    "beh_path_entropy": Family(("beh_path_entropy",), urls=True, sections=True),
    "beh_dwell": Family(("beh_dwell_mean_ms", "beh_dwell_std_ms", "beh_dwell_cv",
                         "beh_short_dwell_ratio"), order=True),
    "beh_momentum": Family(("beh_momentum",), order=True),
    "beh_content": Family(("beh_content_diversity",)),
    "beh_api": Family(("beh_referrer_chain_rate", "beh_api_rate", "beh_api_variety"), urls=True),
    "beh_errors": Family(("beh_continued_after_error",), order=True),
    "llm_timing": Family(("llm_timing_regularity",), order=True),
    "llm_coverage": Family(("llm_systematic_coverage",), urls=True, sections=True),
    "llm_header_anomaly": Family(("llm_header_anomaly",), picks=True),
    "llm_ua": Family(("llm_ua_mismatch",), picks=True),
    "llm_api_probing": Family(("llm_api_probing",), urls=True, endpoints=True),
    "llm_linearity": Family(("llm_session_linearity",), order=True, steps=True),
    "llm_score": Family(("llm_timing_regularity", "llm_systematic_coverage", "llm_header_anomaly",
                         "llm_ua_mismatch", "llm_api_probing", "llm_form_naturalness",
                         "llm_session_linearity", "llm_llm_score"),
                        order=True, urls=True, sections=True, endpoints=True, picks=True, steps=True),
}

FEATURE_NAMES = tuple(
    name for key, family in FAMILIES.items() if not key.startswith("llm_")
    for name in family.names) + FAMILIES["llm_score"].names

AGENT_SCORE = "llm_llm_score"

# attributes of a session that travel with its features
SESSION_COLUMNS = ("session_id", "traffic_class", "label", "user_agent", "ip", "asn", "last_url",
                   "start_ms", "end_ms", "n_requests")

# Values of the whole session that rows carry. They are constant in a session, so they serve as
# grouping keys: strings stay out of the aggregation buffers, which keeps hash aggregation.
ABOUT = {
    "n_requests": "count(1)",
    "t_first": "min(timestamp_ms)",
    "t_last": "max(timestamp_ms)",
    "traffic_class": "max(row_class)",
    "label": "max(row_label)",
    "ip": "max(row_ip)",
    "asn": "max(row_asn)",
    "agent_min": "min(row_agent)",
    "agent_max": "max(row_agent)",
    "user_agent": "min_by(row_agent, struct(timestamp_ms, request_id))",
    "last_url": "max_by(url, struct(timestamp_ms, request_id))",
    "first_n_headers": "min_by(n_headers, struct(timestamp_ms, request_id))",
}
TOTALS = ABOUT | {"resp_mean": "avg(resp_size)"}


def narrowed(requests: DataFrame) -> DataFrame:
    """The columns features read. Maps become counts and flags before anything is shuffled."""
    def present(name: str) -> Column:
        return F.map_contains_key("headers", name).cast("int")

    def optional(name: str) -> Column:
        return F.col(name) if name in requests.columns else F.lit(None).cast("string")

    return requests.select(
        "session_id", "request_id", "timestamp_ms", "url", "status_code", "is_api",
        F.col("user_agent").alias("row_agent"),
        F.col("traffic_class").alias("row_class"),
        F.col("label").alias("row_label"),
        optional("ip").alias("row_ip"),
        optional("asn").alias("row_asn"),
        F.size("headers").alias("n_headers"),
        present("sec-fetch-dest").alias("sec_fetch"),
        present("sec-ch-ua").alias("sec_ch_ua"),
        present("accept-language").alias("accept_language"),
        (F.col("method") == "POST").alias("is_post"),
        (F.col("method") == "GET").alias("is_get"),
        F.col("request_size_bytes").alias("req_size"),
        F.col("response_size_bytes").cast("double").alias("resp_size"),
        (F.coalesce(F.col("referrer"), F.lit("")) != "").alias("has_referrer"))


# --- measures ---------------------------------------------------------------------------------
# name -> (SQL expression, how it merges). SQL text keeps a plan of some 150 expressions quick to
# build from Python; number literals carry D because plain decimals are DECIMAL in Spark SQL.

Measures = dict[str, tuple[str, str]]


def _count_if(condition: str) -> str:
    return f"if({condition}, 1L, 0L)"


API_URL = "contains(url, '/api/')"
CONTENT_KINDS = {
    "product": "contains(url, 'product')",
    "category": "contains(url, 'products') or contains(url, 'category')",
    "api": API_URL,
    "account": "contains(url, 'account') or contains(url, 'login')",
    "static": "contains(url, 'static') or contains(url, '.js') or contains(url, '.css')",
}

# need neither order nor distinct values
PLAIN: Measures = {
    "n": ("1L", "sum"),
    "n_4xx": (_count_if("status_code between 400 and 499"), "sum"),
    "n_404": (_count_if("status_code = 404"), "sum"),
    "n_5xx": (_count_if("status_code >= 500"), "sum"),
    "n_api_flag": (_count_if("is_api"), "sum"),
    "n_probe": (_count_if(f"is_api or {API_URL}"), "sum"),
    "headers_sum": ("n_headers", "sum"),
    "sec_fetch": ("sec_fetch", "max"),
    "sec_ch_ua": ("sec_ch_ua", "max"),
    "accept_language": ("accept_language", "max"),
    "n_post": (_count_if("is_post"), "sum"),
    "n_get": (_count_if("is_get"), "sum"),
    "req_sum": ("req_size", "sum"),
    "resp_sum": ("resp_size", "sum"),
    "n_referrer": (_count_if("has_referrer"), "sum"),
}

# a url times the number of rows it stands for
URL_DEPTH = fn.url_depth("url")


def _url_weighted(weight: str) -> Measures:
    kinds = {f"n_{kind}_url": (f"if({test}, {weight}, 0L)", "sum")
             for kind, test in CONTENT_KINDS.items()}
    return {"depth_max": (URL_DEPTH, "max"), "depth_sum": (f"{URL_DEPTH} * {weight}", "sum")} | kinds


# one distinct url that was requested n times
PER_URL: Measures = {
    "n_urls": ("1L", "sum"),
    "n_api_urls": (_count_if(API_URL), "sum"),
    "url_c_log_c": ("n * log2(n)", "sum"),
}

# rows that carry history and session totals
GAP = "(timestamp_ms - prev1_timestamp_ms)"
MEAN_GAP = "((t_last - t_first) / greatest(n_requests - 1, 1))"
HALF = "(n_requests div 2)"
ORDERED: Measures = {
    "gap_min": (GAP, "min"),
    "gap_max": (GAP, "max"),
    "gap_dev2": (f"power({GAP} - {MEAN_GAP}, 2)", "sum"),
    "n_fast_gaps": (_count_if(f"{GAP} < 100"), "sum"),
    "n_short_gaps": (_count_if(f"{GAP} < 500"), "sum"),
    "first_gap_sum": (f"if(rn - 1 <= {HALF}, {GAP}, null)", "sum"),
    "second_gap_sum": (f"if(rn - 1 > {HALF}, {GAP}, null)", "sum"),
    "last_error_rn": ("if(status_code >= 400, rn, null)", "max"),
    "resp_dev2": ("power(resp_size - resp_mean, 2)", "sum"),
}
STEPS: Measures = {
    "n_backtracks": (_count_if(IS_BACKTRACK), "sum"),
    "n_forward": (_count_if(IS_FORWARD), "sum"),
}


# session values as mergeable aggregates, where no window provides them
PICKS = ABOUT | {
    "resp_dev2": "power(coalesce(stddev_samp(resp_size), 0D), 2) * greatest(count(1) - 1, 1)"}


def _merge(measures: Measures) -> list[Column]:
    return [F.expr(f"{how}({value}) as {name}") for name, (value, how) in measures.items()]


def _again(measures: Measures) -> Measures:
    """The same measures one level up."""
    return {name: (name, how) for name, (_, how) in measures.items()}


def _aggregate(rows: DataFrame, need: Family) -> DataFrame:
    """Rows of a part to one row of measures per session."""
    measures = PLAIN
    session = ["session_id"]
    if need.order:
        measures = measures | ORDERED | (STEPS if need.steps else {})
        session += list(ABOUT)

    if not need.urls:
        picks = {} if need.order else PICKS
        return rows.groupBy(*session).agg(*_merge(measures | _url_weighted("1L")),
                                          *[F.expr(f"{v} as {k}") for k, v in picks.items()])

    by_url = rows.groupBy(*session, "url").agg(*_merge(measures))
    url_level = _again(measures) | _url_weighted("n") | PER_URL
    if not (need.sections or need.endpoints):
        return by_url.groupBy(*session).agg(*_merge(url_level))

    # one row per url and section, and one more per url and endpoint if it was probed
    section = fn.url_section("url")
    valued = by_url.selectExpr(
        *session, *[f"{v} as {k}" for k, (v, _) in url_level.items()],
        "contains(url, '/') as slash",
        f"""explode(if(n_probe > 0,
                array(struct('s' as kind, {section} as value),
                      struct('e' as kind, substring_index(url, '?', 1) as value)),
                array(struct('s' as kind, {section} as value)))) as key""")
    carried = {k: (f"if(key.kind = 's', {k}, null)", how) for k, (_, how) in url_level.items()}
    carried |= {"any_slash": ("if(key.kind = 's', int(slash), null)", "max"),
                "any_no_slash": ("if(key.kind = 's', int(not slash), null)", "max")}
    by_key = valued.groupBy(*session, "key").agg(*_merge(carried))

    top = _again(url_level) | {
        "section_c_log_c": ("if(key.kind = 's', n * log2(n), null)", "sum"),
        "n_sections": (_count_if("key.kind = 's'"), "sum"),
        "n_slash_sections": ("any_slash", "sum"),
        "any_no_slash": ("any_no_slash", "max"),
        "named_blank": ("if(key.kind = 's' and key.value = '' and any_slash = 1, 1, 0)", "max"),
        "n_endpoints": (_count_if("key.kind = 'e'"), "sum"),
    }
    return by_key.groupBy(*session).agg(*_merge(top))


# --- formulas ------------------------------------------------------------------------------------
# feature -> SQL over measures. Denominators are guarded, so no feature is null, NaN or infinite.

HELPERS = {
    "gaps": "greatest(n - 1, 1)",
    "nd": "double(n)",
    "half": "n div 2",
}
ORDER_HELPERS = {
    "gap_mean": "if(n > 1, (t_last - t_first) / greatest(n - 1, 1), 0D)",
    "gap_std": "if(n > 2, sqrt(gap_dev2 / greatest(n - 2, 1)), 0D)",
    "duration_s": "greatest((t_last - t_first) / 1000D, 0.001D)",
}
ENTROPY = "log2(nd) - {s} / nd - {u} * " + f"{fn.ENTROPY_EPS / fn.LN2!r}D"

HTTP = {
    "http_iat_mean_ms": "gap_mean",
    "http_iat_std_ms": "gap_std",
    "http_iat_cv": "gap_std / greatest(gap_mean, 1e-6D)",
    "http_iat_min_ms": "coalesce(gap_min, 0D)",
    "http_iat_max_ms": "coalesce(gap_max, 0D)",
    "http_rpm_mean": "nd / duration_s * 60D",
    "http_burst_ratio": "if(n > 1, n_fast_gaps / double(gaps), 1D)",
    "http_session_depth": "nd",
    "http_session_duration_s": "duration_s",
    "http_error_rate": "(n_4xx + n_5xx) / nd",
    "http_rate_4xx": "n_4xx / nd",
    "http_rate_404": "n_404 / nd",
    "http_rate_5xx": "n_5xx / nd",
    "http_unique_url_ratio": "n_urls / nd",
    "http_api_ratio": "n_api_flag / nd",
    "http_depth_max": "double(depth_max)",
    "http_depth_mean": "depth_sum / nd",
    "http_url_entropy": ENTROPY.format(s="url_c_log_c", u="n_urls"),
    "http_header_completeness": "least(headers_sum / nd / 10D, 1D)",
    "http_has_sec_fetch": "double(sec_fetch)",
    "http_has_sec_ch_ua": "double(sec_ch_ua)",
    "http_has_accept_language": "double(accept_language)",
    "http_header_mean_count": "headers_sum / nd",
    "http_post_ratio": "n_post / nd",
    "http_get_ratio": "n_get / nd",
    "http_req_size_mean": "req_sum / nd",
    "http_resp_size_mean": "resp_sum / nd",
    "http_resp_size_cv": "sqrt(resp_dev2 / gaps) / greatest(resp_sum / nd, 1D)",
    "http_referrer_ratio": "n_referrer / nd",
}

FIRST_MEAN = "(first_gap_sum / greatest(half, 1))"
SECOND_MEAN = "(coalesce(second_gap_sum, 0D) / greatest(n - 1 - half, 1))"
_KINDS = [f"n_{kind}_url" for kind in CONTENT_KINDS]
_PRESENT = [f"int({c} > 0)" for c in (*_KINDS, f"n - ({' + '.join(_KINDS)})")]

# all zero for a single request
BEHAVIOUR = {
    "beh_revisit_ratio": "1D - n_urls / nd",
    "beh_backtrack_rate": "n_backtracks / double(greatest(n - 3, 1))",
    "beh_n_unique_pages": "double(n_urls)",
    "beh_path_entropy": ENTROPY.format(s="section_c_log_c", u="n_sections"),
    "beh_dwell_mean_ms": "gap_mean",
    "beh_dwell_std_ms": "gap_std",
    "beh_dwell_cv": "gap_std / greatest(gap_mean, 1D)",
    "beh_short_dwell_ratio": "n_short_gaps / double(gaps)",
    "beh_momentum": f"if(half > 1, ({SECOND_MEAN} - {FIRST_MEAN}) / greatest({FIRST_MEAN}, 1D), 0D)",
    "beh_content_diversity": f"({' + '.join(_PRESENT)}) / 6D",
    "beh_referrer_chain_rate": "n_referrer / nd",
    "beh_api_rate": "n_api_url / nd",
    "beh_api_variety": "n_api_urls / double(greatest(n_api_url, 1))",
    "beh_continued_after_error": "coalesce((n - last_error_rn) / nd, 0D)",
}

DWELL_CV = "(gap_std / greatest(gap_mean, 1D))"
PREFIXES = "(n_slash_sections + if(named_blank = 1, 0, any_no_slash))"
SIGNALS = {
    "llm_timing_regularity": f"""case when n < 5 then 0D when {DWELL_CV} < 0.05D then 0.3D
        when {DWELL_CV} < 0.35D then greatest(0D, 1D - abs({DWELL_CV} - 0.15D) / 0.35D)
        else greatest(0D, 1D - ({DWELL_CV} - 0.35D) / 2D) end""",
    "llm_systematic_coverage": f"""if(n < 5, 0D, least(1D,
        n_urls / nd * (0.7D + 0.3D * ({PREFIXES} / double(greatest(n_urls, 1))))))""",
    "llm_header_anomaly": """case when first_n_headers <= 3 then 0.9D when first_n_headers <= 6 then 0.7D
        when first_n_headers <= 9 then 0.3D else 0.1D end""",
    "llm_ua_mismatch": f"""case when agent_min <> agent_max then 0.9D
        when lower(user_agent) rlike '{"|".join(BOT_AGENT_WORDS)}' then 0.95D else 0D end""",
    "llm_api_probing": """if(n < 3 or n_probe = 0, 0D, least(1D,
        n_probe / nd * 3D * (0.5D + 0.5D * (n_endpoints / double(n_probe)))))""",
    "llm_form_naturalness": "0D",
    "llm_session_linearity": "if(n < 5, 0D, n_forward / double(gaps))",
}
FORMULAS = HTTP | {k: f"if(n < 2, 0D, {v})" for k, v in BEHAVIOUR.items()} | SIGNALS


def _evaluate(measured: DataFrame, names: Iterable[str], order: bool, keep: Iterable[str],
              config: Settings) -> DataFrame:
    """Features `names` and columns `keep` from a frame of measures."""
    helpers = HELPERS | (ORDER_HELPERS if order else {})
    ready = measured.selectExpr("*", *[f"{v} as {k}" for k, v in helpers.items()])
    direct = [n for n in names if n in FORMULAS]
    result = ready.selectExpr(*keep, "n", *[f"{FORMULAS[k]} as {k}" for k in direct])
    if AGENT_SCORE in names:
        weights = config.agent.weights
        mean = " + ".join(f"{w!r}D * llm_{k}" for k, w in weights.items())
        total = max(sum(weights.values()), 1e-9)
        result = result.withColumn(AGENT_SCORE, F.expr(
            f"least(1D, ({mean}) / {total!r}D + if(n > 20, least(0.15D, (n - 20) / 300D), 0D))"))
    return result.select(*keep, *names)


def combined_need(families: Iterable[str]) -> Family:
    chosen = [FAMILIES[f] for f in families]
    names = tuple(dict.fromkeys(n for f in chosen for n in f.names))
    order, urls, sections, endpoints, picks, steps = (
        any(getattr(f, a) for f in chosen)
        for a in ("order", "urls", "sections", "endpoints", "picks", "steps"))
    return Family(names, order or (urls and picks), urls, sections, endpoints, picks, steps)


def session_features(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """One row per session: its attributes and all 51 features."""
    return features_of_rows(narrowed(requests), config)


def features_of_rows(rows: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """`session_features` of rows that are `narrowed` already."""
    measured = _measured(rows, combined_need(FAMILIES), config)
    named = measured.withColumns({"start_ms": F.col("t_first"), "end_ms": F.col("t_last")})
    return _evaluate(named, FEATURE_NAMES, True, SESSION_COLUMNS, config)


def family_features(requests: DataFrame, *families: str,
                    config: Settings = DEFAULT) -> DataFrame:
    """Session id and the features of some families, by the smallest plan that gives them."""
    need = combined_need(families)
    measured = _measured(narrowed(requests), need, config)
    return _evaluate(measured, need.names, need.order, ["session_id"], config)


def _measured(rows: DataFrame, need: Family, config: Settings) -> DataFrame:
    if not need.order:
        return _aggregate(rows, need)
    lags = {"timestamp_ms": 1} | ({"url": 5} if need.steps else {})
    return split_sessions(rows, config).union_of(
        lambda part: _aggregate(with_history(part, lags, TOTALS), need))


def clean_features(features: DataFrame, names: Iterable[str] = FEATURE_NAMES) -> DataFrame:
    """Null and NaN to 0 and infinities to plus or minus 1e6, for features from other sources."""
    return features.withColumns({n: fn.clean(F.col(n)) for n in names})


def value_entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy of a column per key, by two aggregations."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    return (counts.groupBy(*keys)
            .agg(F.sum("_c").alias("_n"), F.expr("sum(_c * log2(_c)) as _s"),
                 F.count(F.lit(1)).alias("_u"))
            .select(*keys, fn.entropy_from_sums(F.col("_n"), F.col("_s"), F.col("_u")).alias(name)))
