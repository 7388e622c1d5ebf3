"""Order-aware columns per key: position, earlier values, totals, running sums.

All of them work on both parts of a Split. Ordinary keys use one window. A hot key uses one
window per chunk, with the last rows of the chunks before it added as context and its position
shifted by the rows before it, so results equal those of a single window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, Settings
from trafficlens.operators.skew import CHUNK, Split, materialize, split_hot

KEYS = ("session_id",)
ORDER = ("timestamp_ms", "request_id")

# from the fourth request on: the url was seen two or three steps ago
IS_BACKTRACK = "coalesce(rn > 3 and (url = prev2_url or url = prev3_url), false)"
# from the second request on: the url is none of the five before it
IS_FORWARD = "rn > 1 and " + " and ".join(f"not (url <=> prev{k}_url)" for k in range(1, 6))


def earlier(column: str, steps: int) -> str:
    return f"prev{steps}_{column}"


def split_sessions(requests: DataFrame, config: Settings = DEFAULT) -> Split:
    return split_hot(requests, KEYS, ORDER, config.scale)


def _lag_columns(lags: dict[str, int], window) -> list[Column]:
    return [F.lag(c, k).over(window).alias(earlier(c, k))
            for c, depth in lags.items() for k in range(1, depth + 1)]


def _chunk_offsets(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (key, chunk): rows in it and rows of the key before it."""
    sizes = part.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # a stored table, so that its size is known and decides how it is joined
    return materialize(sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "offsets")


def _context_rows(part: DataFrame, offsets: DataFrame, keys: Sequence[str],
                  order: Sequence[str], depth: int) -> DataFrame:
    """For every chunk, the `depth` rows of the key right before it."""
    newest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order])
    tails = (part.withColumn("_back", F.row_number().over(newest))
             .filter(F.col("_back") <= depth)
             .join(offsets, [*keys, CHUNK])
             .withColumn("_pos", F.col("_before") + F.col("_rows") - F.col("_back") + 1))
    # the row at position p precedes the chunks that start after p, p+1, ... p+depth-1 rows
    reach = (tails.drop(CHUNK, "_before", "_rows", "_back")
             .withColumn("_before", F.explode(F.sequence("_pos", F.col("_pos") + depth - 1))))
    starts = offsets.select(*keys, "_before", CHUNK)
    return reach.join(starts, [*keys, "_before"]).select(*part.columns)


def with_history(part: DataFrame, lags: dict[str, int] | None = None,
                 totals: dict[str, str] | None = None,
                 keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """Adds rn (1-based position in the key), earlier values of `lags` and per-key `totals`.

    `totals` are aggregates over the whole key as SQL, such as {"n": "count(1)"}.
    """
    lags, totals = lags or {}, totals or {}
    if CHUNK not in part.columns:
        ordered = Window.partitionBy(*keys).orderBy(*order)
        seen = part.select("*", F.row_number().over(ordered).cast("bigint").alias("rn"),
                           *_lag_columns(lags, ordered))
        return with_totals(seen, totals, keys)

    depth = max(lags.values(), default=0)
    offsets = _chunk_offsets(part, keys)
    rows = part.withColumn("_context", F.lit(False))
    if depth:
        context = _context_rows(part, offsets, keys, order, depth)
        rows = rows.unionByName(context.withColumn("_context", F.lit(True)))
    ordered = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    seen = (rows.select("*", F.row_number().over(ordered).alias("_local"),
                        *_lag_columns(lags, ordered))
            .filter(~F.col("_context"))
            .join(offsets, [*keys, CHUNK])
            .withColumn("rn", F.col("_local") + F.col("_before")
                        - F.least(F.lit(depth), F.col("_before")))
            .drop("_context", "_local", "_before", "_rows"))
    return _join_totals(seen, part, totals, keys)


def with_totals(part: DataFrame, totals: dict[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds aggregates over the whole key to every row, without moving the rows of a part."""
    if CHUNK in part.columns:
        return _join_totals(part, part, totals, keys)
    whole = Window.partitionBy(*keys)
    return part.select("*", *[F.expr(c).over(whole).alias(n) for n, c in totals.items()])


def _join_totals(rows: DataFrame, part: DataFrame, totals: dict[str, str], keys: Sequence[str]) -> DataFrame:
    """Totals of hot keys: one row per key, each with more rows than the hot limit, so few."""
    if not totals:
        return rows
    whole = part.groupBy(*keys).agg(*[F.expr(c).alias(n) for n, c in totals.items()])
    return rows.join(whole, list(keys))


def with_running_sum(part: DataFrame, value: Column, name: str,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds the sum of `value` from the first row of the key to this one, in rn order."""
    upto = (Window.partitionBy(*keys, *([CHUNK] if CHUNK in part.columns else [])).orderBy("rn")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    valued = part.withColumn("_value", value)
    if CHUNK not in part.columns:
        return valued.withColumn(name, F.sum("_value").over(upto)).drop("_value")
    sums = valued.groupBy(*keys, CHUNK).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, CHUNK,
                          F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    return (valued.join(offsets, [*keys, CHUNK])
            .withColumn(name, F.sum("_value").over(upto) + F.col("_offset"))
            .drop("_value", "_offset"))


# --- row-level sequence operators --------------------------------------------------------------

def gaps(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Inter-arrival gaps: n - 1 rows per session, keyed by the position of the earlier request."""
    split = split_sessions(requests, config)
    return split.union_of(lambda part: gaps_of(part).select("session_id", "seq", "gap_ms"))


def gaps_of(part: DataFrame) -> DataFrame:
    """Gaps of a part, which stays a part."""
    prev = earlier("timestamp_ms", 1)
    return (with_history(part.select(*KEYS, *ORDER, *chunk_column(part)), {"timestamp_ms": 1})
            .filter(F.col(prev).isNotNull())
            .select("session_id", (F.col("rn") - 1).alias("seq"),
                    (F.col("timestamp_ms") - F.col(prev)).alias("gap_ms"), *chunk_column(part)))


def chunk_column(part: DataFrame) -> list[str]:
    return [CHUNK] if CHUNK in part.columns else []


def url_steps(requests: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """Per request: is it a backtrack (url seen 2 or 3 steps ago), is it forward (not in last 5)."""
    def build(part: DataFrame) -> DataFrame:
        seen = with_history(part.select(*KEYS, *ORDER, "url", *chunk_column(part)), {"url": 5})
        return seen.selectExpr("session_id", "request_id", "rn as seq",
                               f"{IS_BACKTRACK} as is_backtrack", f"{IS_FORWARD} as is_forward")
    return split_sessions(requests, config).union_of(build)
