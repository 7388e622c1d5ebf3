"""Joins whose keys repeat very often on one side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.skew import materialize

# keys with more than this share of all rows are joined on the map side: fewer than its inverse
HOT_SHARE = 1 / 256


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """Left join of rows with a table of one row per key, which knows how many rows each key has.

    Keys above HOT_SHARE of all counted rows, fewer than 1 / HOT_SHARE, are broadcast, so their rows never meet in one task; the
    others are shuffled. `count` does not come out. The table should be a stored one: it is read several times.
    """
    total = table.agg(F.sum(count)).first()[0] or 0
    heavy = materialize(table.filter(F.col(count) > max(1, total * HOT_SHARE)).drop(count), "heavy")
    names = [c for c in heavy.columns if c != key]
    marked = rows.join(F.broadcast(heavy.withColumn("_hot", F.lit(True))), key, "left")
    light = table.drop(count).join(F.broadcast(heavy.select(key)), key, "left_anti")
    rest = marked.filter("_hot is null").drop("_hot", *names).join(light, key, "left")
    return marked.filter("_hot").drop("_hot").unionByName(rest)
