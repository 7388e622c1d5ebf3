"""Session settings that the jobs are laid out for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # partitions are split or merged at run time towards this size; start with many on a cluster
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "256m",
    # sessions of a stream are merged on the map side first, so a busy key sends few rows
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str = "trafficlens", shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session with these settings. On a cluster give about input bytes / 200 MB partitions and set
    spark.checkpoint.dir to a folder that all executors share."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
