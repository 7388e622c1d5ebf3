"""Versioned folders with a manifest.

A version is written into a folder of its own, and its manifest last, by one committed job: a file that is there is whole, on
any store that Spark writes to. Readers take the newest version that has a manifest, so a save that dies half-way, or
runs beside another one, leaves what they read untouched.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

MANIFEST = "version string, saved_ms bigint"


def _hadoop_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _hadoop_path(spark, path)
    return files.exists(at)


def save(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let `write` fill the folder of a new version, then name it in a manifest."""
    saved = time.time_ns() // 1_000_000
    version = f"{saved:015d}-{uuid.uuid4().hex[:8]}"
    write(f"{path}/versions/{version}")
    spark.createDataFrame([(version, saved)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions that were not pruned, the newest first."""
    if not exists(spark, f"{path}/manifest"):
        return []
    # a manifest has one row per version; versions are made by hand or by jobs, not by data
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    named = [r["version"] for r in sorted(rows, key=lambda r: (r["saved_ms"], r["version"]), reverse=True)]
    return [v for v in named if exists(spark, f"{path}/versions/{v}")]


def folder(spark: SparkSession, path: str, version: str | None = None) -> str:
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no whole version {version or ''} under {path}")
    return f"{path}/versions/{version or known[0]}"


def prune(spark: SparkSession, path: str, keep: int) -> list[str]:
    """Delete the files of all versions but the newest `keep`, and of saves that never got a manifest and are older than those. Returns the names."""
    known = versions(spark, path)[:max(keep, 1)]
    files, at = _hadoop_path(spark, f"{path}/versions")
    if not known or not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    gone = sorted(n for n in names if n < min(known))
    for name in gone:
        files.delete(_hadoop_path(spark, f"{path}/versions/{name}")[1], True)
    return gone
