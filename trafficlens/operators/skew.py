"""Hot keys and distributed numbering.

A window partitioned by a key runs each key in one task. Keys above a row limit are therefore
taken out, range-partitioned on (key, order) so that Spark's own sampling splits them into even
pieces, and written to shared storage once so that the piece numbers never change.
"""

from __future__ import annotations

import atexit
import shutil
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.config import ScaleSettings

CHUNK = "_chunk"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir. A local run without it gets one beside the warehouse, removed at its end."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and context.master.startswith("local"):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        named = f"{warehouse}/trafficlens-{context.applicationId}"
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_SCOPES = threading.local()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/trafficlens/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those named by `keep(materialize(...))`.

    What leaves the block must read kept tables only: they are whole by then, so nothing has to be worked out again.
    """
    opened = _SCOPES.open = getattr(_SCOPES, "open", [])
    paths: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(paths[-1])
        return df

    opened.append(paths)
    try:
        yield keep
    finally:
        opened.pop()
        for outer in opened[-1:]:
            outer += kept
    for path in paths:
        if path not in kept:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary keys, and rows of hot keys cut into ordered chunks (or None)."""

    cold: DataFrame
    hot: DataFrame | None = None

    def union_of(self, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply one builder to both parts. The builder must finish each key within its part."""
        parts = [p for p in (self.cold, self.hot) if p is not None]
        return reduce(DataFrame.unionByName, [build(p) for p in parts])


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int) -> list[Row]:
    """Keys with more than `limit` rows and their count: at most rows / limit of them. One grouped count, which
    is combined before the shuffle and reads the key columns only."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).collect()


def split_hot(df: DataFrame, keys: Sequence[str], order: Sequence[str],
              scale: ScaleSettings) -> Split:
    found = hot_keys(df, keys, scale.hot_rows)
    if not found:
        return Split(df)
    names = df.sparkSession.createDataFrame([tuple(r)[:-1] for r in found], df.select(*keys).schema)
    pieces = sum(-(-row["rows"] // scale.chunk_rows) for row in found)
    hot = (df.join(names, list(keys), "left_semi")
             .repartitionByRange(pieces, *keys, *order)
             .withColumn(CHUNK, F.spark_partition_id()))
    return Split(df.join(names, list(keys), "left_anti"), materialize(hot, "hot"))


def cumulative(df: DataFrame, order: Sequence[Column], sums: dict[str, Column],
               name: str) -> DataFrame:
    """Global running sums over a total order, without a one-task window.

    Rows are range-partitioned on the order; each partition sums on its own and adds the total
    of the partitions before it. The frame of partition totals has one row per partition.
    """
    chunked = materialize(df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()),
                          name)
    before = Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    totals = chunked.groupBy(CHUNK).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # a stored table, so that its size is known and decides how it is joined
    offsets = materialize(totals.select(CHUNK, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums]),
                          "offsets")
    upto = (Window.partitionBy(CHUNK).orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (chunked.join(offsets, CHUNK)
            .select(*[F.col(c) for c in df.columns],
                    *[(F.sum(c).over(upto) + F.col(f"_{n}")).alias(n) for n, c in sums.items()]))


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "numbered") -> DataFrame:
    """Adds row_no, 1-based, over a global total order."""
    return cumulative(df, order, {"row_no": F.lit(1).cast("bigint")}, name)
