"""Rule detector, agent detector and their combination with model scores, all as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.config import BOT_AGENT_WORDS, DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.features import AGENT_SCORE

RULES = ("rate", "regularity", "not_found", "headers", "agent", "depth", "burst")
SIGNALS = ("timing_regularity", "systematic_coverage", "header_anomaly", "ua_mismatch",
           "api_probing", "form_naturalness", "session_linearity")


def _rule_scores(config: Settings) -> dict[str, str]:
    r = config.rules
    return {
        "rate": f"""case when http_rpm_mean >= {r.rate_block_rpm}D then 0.95D
            when http_rpm_mean >= {r.rate_warn_rpm}D then least(0.70D,
                0.40D + 0.30D * (http_rpm_mean - {r.rate_warn_rpm}D) / {r.rate_warn_rpm}D)
            end""",
        "regularity": f"""if(http_iat_cv < {r.iat_cv_bot}D,
            0.75D * (1D - http_iat_cv / {r.iat_cv_bot}D), null)""",
        "not_found": "if(http_rate_404 > 0.15D, least(0.80D, 0.5D + http_rate_404), null)",
        "headers": "if(http_has_sec_fetch = 0D and http_has_accept_language = 0D, 0.70D, null)",
        "agent": f"if(lower(user_agent) rlike '{'|'.join(BOT_AGENT_WORDS)}', 0.97D, null)",
        "depth": f"""if(http_session_depth > {r.max_human_depth},
            least(0.80D, 0.5D + (http_session_depth - {r.max_human_depth}) / 200D), null)""",
        "burst": "if(http_burst_ratio > 0.5D, 0.75D, null)",
    }


def _rule_reasons(config: Settings) -> dict[str, str]:
    r = config.rules
    return {
        "rate": f"""case when http_rpm_mean >= {r.rate_block_rpm}D
            then concat('rpm=', format_string('%.0f', bround(http_rpm_mean, 0)),
                        ' (hard block threshold {r.rate_block_rpm})')
            else concat('rpm=', format_string('%.0f', bround(http_rpm_mean, 0)),
                        ' (warn threshold {r.rate_warn_rpm})') end""",
        "regularity": f"""concat('iat_cv=', {fn.exact_text('http_iat_cv', 3)},
            ' (too regular, threshold={r.iat_cv_bot})')""",
        "not_found": f"concat('404_rate=', {fn.exact_text('http_rate_404', 2)})",
        "headers": "'missing critical browser headers (sec-fetch, accept-language)'",
        "agent": "concat('bot user-agent detected: ', substring(user_agent, 1, 50))",
        "depth": f"""concat('session_depth=', format_string('%.0f', http_session_depth),
            ' (>{r.max_human_depth})')""",
        "burst": f"""concat('burst_ratio=', {fn.exact_text('http_burst_ratio', 2)},
            ' (>0.5)')""",
    }


def with_rules(features: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Adds rule_<name> (null when the rule did not fire), statistical_score and its reason."""
    scores, reasons = _rule_scores(config), _rule_reasons(config)
    fired = features.selectExpr("*", *[f"{v} as rule_{k}" for k, v in scores.items()])
    best = ", ".join(f"rule_{k}" for k in RULES)
    text = ", ".join(f"if(rule_{k} is not null, {reasons[k]}, null)" for k in RULES)
    return (fired.selectExpr("*", f"coalesce(greatest({best}), 0D) as _rule")
            .selectExpr("*", f"{fn.exact_round('_rule')} as statistical_score",
                        f"coalesce(nullif(concat_ws(' | ', {text}), ''), 'CLEAN') as statistical_reason")
            .drop("_rule"))


def with_agent_score(features: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Adds llm_score and llm_confidence from the fingerprint features."""
    enough = f"n_requests >= {config.features.min_requests_to_score}"
    return features.selectExpr(
        "*", f"if({enough}, {fn.exact_round(AGENT_SCORE)}, 0D) as llm_score",
        f"""case when not ({enough}) then 'INSUFFICIENT_DATA' when n_requests < 10 then 'LOW'
            when n_requests < 30 then 'MEDIUM' else 'HIGH' end as llm_confidence""")


def predict(scored: DataFrame, score: str, cut: float = 0.5) -> DataFrame:
    return scored.withColumn("prediction", F.expr(f"int({score} >= {cut}D)"))


def explain_agent(scored: DataFrame) -> DataFrame:
    """One row per session and signal: value, whether it is high, and the verdict."""
    pairs = ", ".join(f"'{s}', if(llm_confidence = 'INSUFFICIENT_DATA', null, llm_{s})" for s in SIGNALS)
    return (scored.selectExpr("session_id", "n_requests", "llm_score", "llm_confidence",
                              f"stack({len(SIGNALS)}, {pairs}) as (signal, value)")
            .filter("value is not null")
            .selectExpr("*", "value > 0.5D as is_high",
                        "if(llm_score >= 0.5D, 'AGENT', 'NOT AGENT') as verdict"))


def with_ensemble(scored: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Adds n_detectors_firing, risk_score, llm_signals and explanation.

    A model score that is not there counts as 0, as for a model that was never trained.
    """
    for name in ("isolation_score", "gb_score"):
        if name not in scored.columns:
            scored = scored.withColumn(name, F.lit(0.0))
    e = config.ensemble
    weights = {"statistical_score": e.statistical, "isolation_score": e.isolation,
               "gb_score": e.boosting, "llm_score": e.agent}
    mean = " + ".join(f"{w!r}D * {c}" for c, w in weights.items())
    total = max(sum(weights.values()), 1e-9)
    best = ", ".join(weights)
    signals = ", ".join(f"'{s}', llm_{s}" for s in SIGNALS)
    explanation = f"""concat('Statistical=', {fn.exact_text('statistical_score', 3)},
        '[', substring(statistical_reason, 1, 40), '] | IF=', {fn.exact_text('isolation_score', 3)},
        ' | GB=', {fn.exact_text('gb_score', 3)}, ' | LLM=', {fn.exact_text('llm_score', 3)},
        '[', llm_confidence, '] | Ensemble=', {fn.exact_text('risk_score', 3)},
        ' | Firing=', n_detectors_firing, '/4')"""
    combined = (scored
                .selectExpr("*", f"({mean}) / {total!r}D as _mean", f"greatest({best}) as _best",
                            " + ".join(f"int({c} > 0.5D)" for c in weights) + " as n_detectors_firing")
                .selectExpr("*", f"if(_best >= {e.override_at}D, greatest(_mean, _best * 0.95D), _mean) as _lifted")
                .selectExpr("*", f"""least(greatest(if(n_detectors_firing >= {e.min_agreement},
                    least(1D, _lifted * 1.1D), _lifted), 0D), 1D) as risk_score""")
                .drop("_mean", "_best", "_lifted"))
    return settled(combined, [*weights, "risk_score", "n_detectors_firing", "statistical_reason", "llm_confidence"]).selectExpr(
        "*", f"if(llm_confidence = 'INSUFFICIENT_DATA', map(), map({signals})) as llm_signals",
        f"{explanation} as explanation")


def settled(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows with `names` as outputs of a generator.

    A later filter on a score would otherwise be pushed down with the whole formula copied into it,
    once per use; conditions on generator outputs stay where they are written.
    """
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))


def score_without_models(features: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    return with_ensemble(with_agent_score(with_rules(features, config), config), config)
