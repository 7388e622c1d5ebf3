"""Operators for settings that name a signal: histograms, runs, rates and z-scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.features import family_features, value_entropy
from trafficlens.operators.sequence import (KEYS, ORDER, chunk_column, gaps_of, split_sessions,
                                            with_history, with_running_sum, with_totals)
from trafficlens.operators.skew import materialize, split_hot


def iat_histogram(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Gaps per session in equal bins between its shortest and longest gap."""
    bins = config.features.iat_bins
    width = (F.col("high") - F.col("low")) / bins
    index = F.when(width <= 0, 1).otherwise(
        F.least(F.lit(bins), F.floor((F.col("gap_ms") - F.col("low")) / width) + 1))

    def build(part: DataFrame) -> DataFrame:
        spread = with_totals(gaps_of(part), {"low": "min(gap_ms)", "high": "max(gap_ms)"})
        return (spread.withColumn("bin", index.cast("int"))
                .groupBy("session_id", "bin").agg(F.count(F.lit(1)).alias("n_gaps")))

    return split_sessions(requests, config).union_of(build)


def url_entropy_recent(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Entropy of the last urls of each session. The rank limit applies before the shuffle."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("timestamp_ms"), F.desc("request_id"))
    recent = (requests.select(*KEYS, *ORDER, "url").withColumn("_back", F.row_number().over(newest))
              .filter(F.col("_back") <= config.features.url_entropy_window))
    return value_entropy(recent, ["session_id"], "url", "url_entropy")


def missing_headers(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Per request: which browser headers are absent, and how many."""
    wanted = F.array(*[F.lit(h) for h in config.features.browser_headers])
    absent = F.array_except(wanted, F.map_keys("headers"))
    return requests.select("session_id", "request_id", F.size(absent).alias("n_missing"),
                           F.array_join(F.array_sort(absent), ",").alias("missing"))


def rpm_zscore(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Distance of a session's rate from the mean of all sessions, in standard deviations."""
    rates = requests.groupBy("session_id").agg(
        (F.count(F.lit(1)) / F.greatest((F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000.0,
                                        F.lit(0.001)) * 60.0).alias("rpm"))
    rates = materialize(rates, "rates")  # read twice: for the mean and for the rows
    whole = rates.groupBy().agg(F.struct(F.avg("rpm").alias("mean"), F.stddev_samp("rpm").alias("std"))).scalar()
    z = (F.col("rpm") - whole["mean"]) / F.greatest(whole["std"], F.lit(1e-9))
    return rates.withColumn("zscore", F.coalesce(z, F.lit(0.0))).withColumn(
        "is_outlier", F.col("zscore") > config.rules.zscore)


def consecutive_404s(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Longest run of 404 per session, 0 without any. A run is the 404 rows with equal count of others before."""
    def build(part: DataFrame) -> DataFrame:
        rows = with_history(part.select(*KEYS, *ORDER, "status_code", *chunk_column(part)))
        marked = with_running_sum(rows, fn.flag(F.col("status_code") != 404), "run")
        runs = marked.groupBy("session_id", "run").agg(F.sum(fn.flag(F.col("status_code") == 404)).alias("length"))
        return runs.groupBy("session_id").agg(F.max("length").alias("longest"))

    longest = split_sessions(requests, config).union_of(build)
    return longest.withColumn("too_many", F.col("longest") >= config.rules.max_consecutive_404s)


def timing_flag(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Sessions whose gaps vary less than the limit."""
    timing = family_features(requests, "http_timing", config=config)
    return timing.select("session_id", "http_iat_std_ms",
                         (F.col("http_iat_std_ms") < config.agent.timing_std_ms).alias("is_regular"))


def regular_runs(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Longest run of gaps within 10 % of the gap before, per session."""
    gap = F.col("timestamp_ms") - F.col("prev1_timestamp_ms")
    before = F.col("prev1_timestamp_ms") - F.col("prev2_timestamp_ms")

    def build(part: DataFrame) -> DataFrame:
        rows = with_history(part.select(*KEYS, *ORDER, *chunk_column(part)), {"timestamp_ms": 2})
        near = rows.withColumn("near", F.coalesce(F.abs(gap - before) <= 0.1 * before, F.lit(False)))
        marked = with_running_sum(near, fn.flag(~F.col("near")), "run")
        runs = marked.groupBy("session_id", "run").agg(F.sum(fn.flag(F.col("near"))).alias("length"))
        return runs.groupBy("session_id").agg(F.max("length").alias("longest"))

    longest = split_sessions(requests, config).union_of(build)
    return longest.withColumn("is_regular", F.col("longest") >= config.features.regularity_run)


def peak_rpm(requests: DataFrame) -> DataFrame:
    """Most requests of a session in any trailing 60 seconds.

    Equal times are counted first. A minute then needs its own rows and those of the minute before,
    so windows run per (session, minute): as large as the distinct times of two minutes.
    """
    counted = (requests.groupBy("session_id", "timestamp_ms").agg(F.count(F.lit(1)).alias("c"))
               .withColumn("minute", F.floor(F.col("timestamp_ms") / 60000)))
    both = counted.select("session_id", "timestamp_ms", "c", F.col("minute").alias("own"),
                          F.explode(F.array("minute", F.col("minute") + 1)).alias("minute"))
    trailing = (Window.partitionBy("session_id", "minute").orderBy("timestamp_ms")
                .rangeBetween(-59999, Window.currentRow))
    return (both.withColumn("n", F.sum("c").over(trailing)).filter("own = minute")
            .groupBy("session_id").agg(F.max("n").alias("peak_rpm")))


def sessionize_gap(requests: DataFrame, config: Settings = DEFAULT, key: str = "ip") -> DataFrame:
    """Cut the requests of a key into sessions wherever the gap reaches the limit."""
    limit = config.features.session_gap_seconds * 1000.0
    order = ["timestamp_ms", "request_id"]

    def build(part: DataFrame) -> DataFrame:
        rows = with_history(part, {"timestamp_ms": 1}, keys=[key], order=order)
        starts = fn.flag(F.col("prev1_timestamp_ms").isNull()
                         | (F.col("timestamp_ms") - F.col("prev1_timestamp_ms") >= limit))
        return (with_running_sum(rows, starts, "session_no", keys=[key])
                .groupBy(key, "session_no")
                .agg(F.count(F.lit(1)).alias("n_requests"), F.min("timestamp_ms").alias("start_ms"),
                     F.max("timestamp_ms").alias("end_ms")))

    narrow = requests.select(key, *order)
    return split_hot(narrow, [key], order, config.scale).union_of(build)


def rpm_windows(requests: DataFrame, key: str = "session_id", length: str = "1 minute",
                slide: str | None = None, limit: int = DEFAULT.mitigation.throttle_rpm) -> DataFrame:
    """Requests per key and time window, and whether they exceed a rate limit."""
    at = fn.event_time(F.col("timestamp_ms"))
    frame = F.window(at, length, slide) if slide else F.window(at, length)
    return (requests.groupBy(key, frame.alias("w")).agg(F.count(F.lit(1)).alias("n_requests"))
            .select(key, F.unix_millis("w.start").alias("window_start_ms"), "n_requests",
                    (F.col("n_requests") > limit).alias("over_limit")))


def first_n_per_class(sessions: DataFrame, n: int) -> DataFrame:
    """The first n sessions of each class. The rank limit applies before the shuffle."""
    by_start = Window.partitionBy("traffic_class").orderBy("start_ms", "session_id")
    return sessions.withColumn("rank", F.row_number().over(by_start)).filter(F.col("rank") <= n)


DAY_MS = 86_400_000
# log2 of the registers of a distinct count; its relative standard error is 1.04 / sqrt(2 ** REGISTERS), 1.6 % here
REGISTERS = 12


def day_sketches(rows: DataFrame, keys: list[str], value: str, registers: int = REGISTERS) -> DataFrame:
    """keys, day, sketch: what is needed to count distinct values over any range of days later. A sketch takes some
    kilobytes at most, however many values it has seen."""
    day = F.floor(F.col("timestamp_ms") / DAY_MS).alias("day")
    return rows.groupBy(*keys, day).agg(F.hll_sketch_agg(value, registers).alias("sketch"))


def distinct_over_days(sketches: DataFrame, keys: list[str], first: int | None = None, last: int | None = None) -> DataFrame:
    """keys, n_distinct over the days from `first` to `last`, both included: sketches are merged, rows are not read again."""
    day = F.col("day")
    chosen = sketches.filter((day >= first if first is not None else F.lit(True)) & (day <= last if last is not None else F.lit(True)))
    return chosen.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
