"""The request log: schema, the view over an event table, flat and nested forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions import columns as fn
from trafficlens.operators.sequence import chunk_column, with_history
from trafficlens.operators.skew import split_hot

REQUEST_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("request_id", T.LongType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("timestamp_ms", T.DoubleType(), False),
    T.StructField("method", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("status_code", T.IntegerType(), False),
    T.StructField("response_time_ms", T.DoubleType(), True),
    T.StructField("headers", T.MapType(T.StringType(), T.StringType()), False),
    T.StructField("user_agent", T.StringType(), False),
    T.StructField("ip", T.StringType(), True),
    T.StructField("request_size_bytes", T.LongType(), False),
    T.StructField("response_size_bytes", T.LongType(), False),
    T.StructField("is_api", T.BooleanType(), False),
    T.StructField("referrer", T.StringType(), True),
    T.StructField("traffic_class", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("asn", T.StringType(), True),
    T.StructField("ja3", T.StringType(), True),
])

# Header names sent by each kind of client.
PLAIN_HEADERS = ("accept", "user-agent")
PARTIAL_HEADERS = ("accept", "accept-language", "accept-encoding", "user-agent")
FULL_HEADERS = (
    "accept", "accept-language", "accept-encoding", "sec-fetch-dest", "sec-fetch-mode",
    "sec-fetch-site", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform",
    "upgrade-insecure-requests",
)

DAY_ONE_US = 1_704_067_200_000_000  # 2024-01-01, first day of the event table
BASE_MS = 1_700_000_000_000


def _headers(names: tuple[str, ...]) -> str:
    return "map(" + ", ".join(f"'{name}', '1'" for name in names) + ")"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


EVENT_COLUMNS = (
    "event_id", "user_id", "event_type", "value",
    "cast(regexp_extract(props, '[0-9]+', 0) as int) as k",
    "cast(user_id as string) as session_id",
    """case user_id % 10 when 0 then 'simple_bot' when 1 then 'scraper'
         when 2 then 'cred_stuffer' when 3 then 'llm_agent' else 'human' end as traffic_class""",
)
URL_OF_EVENT = """
    case when traffic_class = 'cred_stuffer' then '/account/login'
         when event_type = 'view' then concat('/product/', 1000 + k % 6)
         when event_type = 'click' then concat('/products/c', k % 4, '/')
         when event_type = 'purchase' then '/checkout'
         when event_type = 'signup' then '/account/register'
         when k % 2 = 0 then concat('/api/search?q=', k)
         else concat('/static/', k, '.js') end as url"""
REQUEST_COLUMNS = (
    "session_id",
    "event_id as request_id",
    "rn as seq",
    f"""double({BASE_MS} + case traffic_class
          when 'simple_bot' then rn * 200 + k % 10
          when 'scraper' then rn * 1500 + k * 10
          when 'cred_stuffer' then rn * 300 + k
          when 'llm_agent' then rn * 800 + k * 4
          else (ts_us - {DAY_ONE_US}) div 10000000 end) as timestamp_ms""",
    """if(traffic_class = 'cred_stuffer' or event_type in ('signup', 'purchase'),
          'POST', 'GET') as method""",
    "url",
    """case when traffic_class = 'cred_stuffer' then 401
          when event_type = 'error' and k < 50 then 404
          when event_type = 'error' and k < 70 then 500 else 200 end as status_code""",
    "80D as response_time_ms",
    f"""case traffic_class when 'simple_bot' then {_headers(PLAIN_HEADERS)}
          when 'scraper' then {_headers(PARTIAL_HEADERS)}
          else {_headers(FULL_HEADERS)} end as headers""",
    """case when traffic_class = 'simple_bot' then 'python-requests/2.31.0'
          when traffic_class = 'scraper' and rn % 7 = 0 then 'Mozilla/5.0 (X11; Linux x86_64)'
          else 'Mozilla/5.0 (Windows NT 10.0; Win64; x64)' end as user_agent""",
    "concat('10.0.', user_id div 40, '.', user_id % 20) as ip",
    "bigint(200 + k * 18) as request_size_bytes",
    "5000 + floor(value * 100) as response_size_bytes",
    "event_type = 'error' and k % 2 = 0 and traffic_class <> 'cred_stuffer' as is_api",
    "if(traffic_class in ('human', 'llm_agent'), prev1_url, null) as referrer",
    "traffic_class",
    "if(traffic_class = 'human', 0, 1) as label",
    "case user_id % 9 when 0 then 'AS15169' when 1 then 'AS8075' else 'AS64500' end as asn",
    """case traffic_class when 'simple_bot' then '5765db2da7f2bfc028a93aca42df2e45'
          when 'scraper' then 'e7d705a3286e19ea42f587b344ee6865' else 'browser' end as ja3""",
)


def requests_from_events(events: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """One request per event, one session per user; see FIXTURES.md for the mapping.

    The session id is computed before the window, so that the hash partitioning of the numbering
    is the one every per-session operator needs afterwards: no second shuffle.
    """
    order = ["ts_us", "event_id"]
    base = (events.withColumn("ts_us", fn.epoch_micros(F.col("ts")))
            .selectExpr("ts_us", *EVENT_COLUMNS).selectExpr("*", URL_OF_EVENT))

    def build(part: DataFrame) -> DataFrame:
        return with_history(part, {"url": 1}, order=order).selectExpr(*REQUEST_COLUMNS)

    return split_hot(base, ["session_id"], order, config.scale).union_of(build)


def request_log(requests: DataFrame) -> DataFrame:
    """The flat 15-column log."""
    return requests.select(
        "session_id", "traffic_class", "label", "ip", "timestamp_ms", "method", "url",
        "status_code", "response_time_ms", "user_agent", "is_api", "request_size_bytes",
        "response_size_bytes", F.size("headers").alias("n_headers"),
        F.col("referrer").isNotNull().alias("has_referrer"))


def write_request_log(requests: DataFrame, path: str, by: str = "traffic_class") -> None:
    request_log(requests).write.partitionBy(by).parquet(path)


def session_summary(requests: DataFrame) -> DataFrame:
    """Requests, start and duration per session.

    Class and label are constant in a session, so they are grouping keys first: only numbers are
    aggregated over requests, and the texts are picked among the few rows that are left.
    """
    first = (requests.groupBy("session_id", "traffic_class", "label")
             .agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_ms").alias("low"), F.max("timestamp_ms").alias("high")))
    return (first.groupBy("session_id")
            .agg(F.sum("n").alias("n_requests"), (F.max("high") - F.min("low")).alias("duration_ms"),
                 F.min("low").alias("start_time_ms"), F.max("traffic_class").alias("traffic_class"),
                 F.max("label").alias("label")))


def nested_sessions(requests: DataFrame, part_size: int = 1_000, config: Settings = DEFAULT) -> DataFrame:
    """Sessions as arrays of requests, for systems that need that form: session_id, part_no, n_requests, requests.

    An array lives in one row, so a session is cut into parts of `part_size` requests in order, from 0 on.
    Every request is in exactly one part, however long its session.
    """
    order = ["timestamp_ms", "request_id"]
    fields = [*order, "method", "url", "status_code", "headers", "user_agent", "request_size_bytes", "response_size_bytes",
              "is_api", "referrer"]

    def build(part: DataFrame) -> DataFrame:
        placed = with_history(part.select("session_id", *fields, *chunk_column(part)), order=order)
        return placed.select("session_id", F.floor((F.col("rn") - 1) / part_size).alias("part_no"),
                             F.struct("rn", *fields).alias("_request"))

    rows = split_hot(requests, ["session_id"], order, config.scale).union_of(build)
    # headers are a map, which has no order: the position decides
    parts = rows.groupBy("session_id", "part_no").agg(F.count(F.lit(1)).alias("n_requests"), F.collect_list("_request").alias("requests"))
    return parts.withColumn("requests", F.array_sort("requests", lambda a, b: (a["rn"] - b["rn"]).cast("int")))
