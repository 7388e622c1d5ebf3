"""Scalar column functions on urls, agents, statuses, times and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from trafficlens.config import BOT_AGENT_WORDS, CLASS_LABELS

ENTROPY_EPS = 1e-12
LN2 = 0.6931471805599453


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it does not or is null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("bigint")


def tidy(value: Column, digits: int = 6) -> Column:
    """Round for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def decimal_units(value: str, digits: int) -> str:
    """SQL text: value * 10^digits as a whole number, rounded on the exact binary value.

    Ties go to even, so scores and texts equal what correctly rounding languages print. For values
    in [0, 2): away from a tie plain rounding is exact; near one, the bits down to 2^-102 become a
    whole decimal number, and the rest is decimal arithmetic.
    """
    near = f"(({value}) * {10**digits}D)"
    high = f"(({value}) * {2**62}D)"
    low = f"bigint(({high} - double(bigint({high}))) * {2**40}D)"
    scaled = f"((cast(bigint{high} as decimal(19, 0)) * {2**40}BD + {low}) * {10**digits})"
    whole, rest = f"({scaled} div {2**102}BD)", f"({scaled} % {2**102}BD)"
    exact = f"{whole} + case when {rest} > {2**101}BD or ({rest} = {2**101}BD and {whole} % 2 = 1) then 1L else 0L end"
    return (f"if(abs({near} - floor({near}) - 0.5D) > 1e-6D, bigint(floor({near} + 0.5D)), {exact})")


def exact_round(value: str, digits: int = 4) -> str:
    return f"({decimal_units(value, digits)} / {10**digits}D)"


def exact_text(value: str, digits: int) -> str:
    units = decimal_units(value, digits)
    return f"concat({units} div {10**digits}, '.', lpad(string({units} % {10**digits}), {digits}, '0'))"


def clean(value: Column) -> Column:
    """Null and NaN to 0, +inf to 1e6, -inf to -1e6."""
    inf = float("inf")
    return (F.when(value.isNull() | F.isnan(value), F.lit(0.0))
             .when(value == F.lit(inf), F.lit(1e6))
             .when(value == F.lit(-inf), F.lit(-1e6))
             .otherwise(value))


def epoch_micros(ts_ntz: Column) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ, whatever the session time zone is."""
    since = ts_ntz.cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    hours = F.extract(F.lit("DAY"), since) * 24 + F.extract(F.lit("HOUR"), since)
    minutes = hours.cast("bigint") * 60 + F.extract(F.lit("MINUTE"), since)
    second_us = (F.extract(F.lit("SECOND"), since) * 1000000).cast("bigint")
    return minutes.cast("bigint") * F.lit(60000000) + second_us


def event_time(timestamp_ms: Column) -> Column:
    return F.timestamp_micros((timestamp_ms * 1000).cast("bigint"))


# --- urls -------------------------------------------------------------------------------

def url_depth(url: str) -> str:
    """SQL text: number of path parts once trailing slashes are gone."""
    return f"(size(split(regexp_replace({url}, '/+$', ''), '/')) - 1)"


def url_section(url: str) -> str:
    """SQL text: what is between the first and second slash; the url itself when it has no slash."""
    return f"if(contains({url}, '/'), get(split({url}, '/', 3), 1), {url})"


def page_context(url: Column) -> Column:
    return (F.when(url.contains("/checkout"), "checkout")
             .when(url.contains("login"), "login")
             .when(url.contains("search"), "search")
             .otherwise("general"))


# --- agents, statuses, classes ------------------------------------------------------------

def is_bot_agent(user_agent: Column) -> Column:
    return F.lower(user_agent).rlike("|".join(BOT_AGENT_WORDS))


def class_label(traffic_class: Column) -> Column:
    pairs = [F.lit(x) for item in CLASS_LABELS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), traffic_class)


def binary_label(traffic_class: Column) -> Column:
    return F.when(traffic_class == "human", 0).otherwise(1)


# --- attack signatures -----------------------------------------------------------------------

# Signatures in order of precedence, searched without regard to case.
ATTACK_WORDS = {
    "sql_injection": ("union", "select", "drop", "insert", "delete", "--", "/*"),
    "xss": ("<script", "javascript:", "onerror=", "onload=", "alert("),
    "path_traversal": ("../", "/etc/", "/proc/", "/windows/"),
    "command_injection": (";ls", ";cat", "&&", "`", "%0a", "%0d"),
}
QUOTED_OR = r"(?U)'\s*or"
# a run of 500 characters without & or =, tried only where a run starts
LONG_VALUE = r"(?:^|[&=])[^&=]{500}"
# letters that fold to s, i, i and k
ODD_LETTERS, PLAIN_LETTERS = "\u017f\u0131\u0130\u212a", "siik"


def fold_case(text: Column) -> Column:
    odd = reduce(Column.__or__, [text.contains(c) for c in ODD_LETTERS])
    return F.lower(F.when(odd, F.translate(text, ODD_LETTERS, PLAIN_LETTERS)).otherwise(text))


def attack_type(text: Column, folded: Column) -> Column:
    """First signature that a text shows; `folded` is the text after fold_case.

    Plain substring search instead of case-insensitive alternations: bytes are compared in place.
    """
    found = {kind: reduce(Column.__or__, [folded.contains(w) for w in words])
             for kind, words in ATTACK_WORDS.items()}
    found["sql_injection"] |= folded.contains("'") & folded.rlike(QUOTED_OR)
    chain = F
    for kind, test in found.items():
        chain = chain.when(test, kind)
    return chain.when(text.rlike(LONG_VALUE), "buffer_overflow").otherwise("other_anomaly")


# --- entropy --------------------------------------------------------------------------------

def entropy_from_sums(total: Column, sum_c_log_c: Column, n_values: Column) -> Column:
    """Shannon entropy in bits from sums, with the 1e-12 smoothing to first order.

    -sum(p log2(p + e)) = log2(n) - sum(c log2 c)/n - (number of values) * e / ln 2
    """
    n = F.greatest(total.cast("double"), F.lit(1.0))
    smoothing = n_values * F.lit(ENTROPY_EPS / LN2)
    return F.log2(n) - sum_c_log_c / n - smoothing
