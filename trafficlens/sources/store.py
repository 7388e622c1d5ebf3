"""A request table that session operators read without moving a row.

Bucketed by session and sorted by session and time: windows and groupings by session find their rows together, so features,
sequences and sessions need no exchange, whatever is asked of the table later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KEY, ORDER = "session_id", ("session_id", "timestamp_ms", "request_id")


def write_store(requests: DataFrame, name: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store the requests as a table of that many buckets, one sorted file each, and read it. About 200 MB a bucket is a good size."""
    # one task per bucket, so that a bucket is one file and its order holds
    dealt = requests.repartition(buckets, KEY)
    writer = dealt.write.format("parquet").mode("overwrite").bucketBy(buckets, KEY).sortBy(*ORDER)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return requests.sparkSession.table(name)


def open_store(spark: SparkSession, name: str, buckets: int, path: str, requests: DataFrame) -> DataFrame:
    """Name a stored table again, in an application whose catalog does not know it; `requests` gives the columns."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by ({KEY}) sorted by ({', '.join(ORDER)}) "
              f"into {buckets} buckets location '{path}'")
    return spark.table(name)
