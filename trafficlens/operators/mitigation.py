"""Risk to action, with page context, allow-list and action parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.sequence import with_history
from trafficlens.operators.skew import split_hot


def allowed(config: Settings = DEFAULT) -> Column:
    """The list is a handful of settings, so it is a literal set and needs no join."""
    return F.coalesce(F.col("asn").isin(*config.mitigation.allowed_asns), F.lit(False))


def allowed_by_table(sessions: DataFrame, allow_table: DataFrame) -> DataFrame:
    """Adds is_allowed from a table of asn. Spark picks the join by the size it measures."""
    listed = allow_table.select("asn").distinct().withColumn("_listed", F.lit(True))
    return (sessions.join(listed, "asn", "left")
            .withColumn("is_allowed", F.coalesce("_listed", F.lit(False))).drop("_listed"))


def known_ja3(requests: DataFrame, keep_known: bool = True, config: Settings = DEFAULT) -> DataFrame:
    known = F.coalesce(F.col("ja3").isin(*config.features.known_ja3), F.lit(False))
    return requests.filter(known if keep_known else ~known)


def context_shift(context: Column, config: Settings = DEFAULT) -> Column:
    sign = -1.0 if config.mitigation.stricter_context else 1.0
    pairs = [F.lit(x) for k, v in config.mitigation.context_shift.items() for x in (k, sign * v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), context), F.lit(0.0))


def decide(scored: DataFrame, config: Settings = DEFAULT, context: str | Column | None = None,
           allow_list: bool = False) -> DataFrame:
    """One decision per session.

    `context` is a page context or a column of them; without it every page is general.
    """
    m = config.mitigation
    page = F.lit("general") if context is None else F.lit(context) if isinstance(context, str) else context
    staged = scored.withColumn("page_context", page)
    staged = staged.withColumn("_risk", F.col("risk_score") + context_shift(F.col("page_context"), config))
    free = allowed(config) if allow_list else F.lit(False)
    action = F.when(free, "allow")
    for name, floor in m.floors.items():
        action = action.when(F.col("_risk") >= floor, name)
    staged = staged.withColumn("action", action.otherwise("allow")).withColumn("_free", free)
    at = F.col("action")
    return staged.select(
        *[c for c in ("session_id", "ip", "traffic_class", "label", "end_ms") if c in scored.columns],
        "risk_score", "page_context", "action",
        F.when(F.col("_free"), "allowlisted IP/ASN").when(at == "allow", "clean traffic")
         .otherwise(F.col("explanation")).alias("reason"),
        F.when(at == "throttle", m.delay_ms).otherwise(0).alias("delay_ms"),
        F.when(at == "block", m.block_ttl_s).otherwise(0).alias("block_ttl_s"),
        F.when(at == "challenge", m.challenge_type).alias("challenge_type"))


def decide_in_context(scored: DataFrame, config: Settings = DEFAULT,
                      allow_list: bool = False) -> DataFrame:
    """Decision with the context of the last page of the session."""
    return decide(scored, config, fn.page_context(F.col("last_url")), allow_list)


def action_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("n_decisions"))


def repeat_offenders(decisions: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Blocks with the number of earlier blocks of the same ip."""
    order = ["end_ms", "session_id"]
    blocks = decisions.filter("action = 'block'").select("ip", *order, "risk_score")

    def build(part: DataFrame) -> DataFrame:
        seen = with_history(part, keys=["ip"], order=order)
        return seen.select("ip", *order, (F.col("rn") - 1).alias("earlier_blocks"))

    return split_hot(blocks, ["ip"], order, config.scale).union_of(build)
