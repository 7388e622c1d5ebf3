"""Live block registry: which addresses are blocked now, and until when."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (ExpiredTimerInfo, StatefulProcessor,
                                                      StatefulProcessorHandle, TimerValues)

from trafficlens.config import DEFAULT, Settings

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_SCHEMA = "ip string, blocked_from_ms bigint, blocked_until_ms bigint, n_blocks bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def merge_blocks(blocks: list[tuple]) -> list[tuple]:
    """Blocks (from, until, count) in time order, joined where one starts before the last ends."""
    joined: list[tuple] = []
    for since, until, n in sorted(blocks):
        if joined and since < joined[-1][1]:
            before = joined.pop()
            since, until, n = before[0], max(before[1], until), before[2] + n
        joined.append((since, until, n))
    return joined


class BlockRegistry(StatefulProcessor):
    """Per address: start, end and count of the latest block; a block inside it extends it."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "since bigint, until bigint, n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        blocks = [self.block.get()] if self.block.exists() else []
        # rows of a key come in chunks; a chunk shrinks to its blocks, which are a ttl apart
        for chunk in rows:
            times = chunk["at_ms"].sort_values()
            run = (times.diff() >= self.ttl_ms).cumsum()
            found = times.groupby(run).agg(["min", "max", "count"])
            blocks += [(int(a), int(b) + self.ttl_ms, int(n)) for a, b, n in found.itertuples(index=False)]
            blocks = merge_blocks(blocks)
        since, until, n = blocks[-1]
        self.block.update((since, until, n))
        self.handle.registerTimer(until)
        yield pd.DataFrame({"ip": [key[0]], "blocked_from_ms": [since], "blocked_until_ms": [until], "n_blocks": [n]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.block.exists() and self.block.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.block.clear()
        return iter(())

    def close(self) -> None:
        pass


def live_blocks(decisions: DataFrame, delay: str = "10 minutes", config: Settings = DEFAULT) -> DataFrame:
    """Block decisions (ip, action, end_ms) to the current block of each address, in update mode.

    State expires with event time, so it holds addresses blocked within the ttl only.
    """
    blocks = (decisions.filter("action = 'block'")
              .select("ip", F.col("end_ms").cast("bigint").alias("at_ms"),
                      F.timestamp_millis(F.col("end_ms").cast("bigint")).alias("ts"))
              .withWatermark("ts", delay))
    return blocks.groupBy("ip").transformWithStateInPandas(
        statefulProcessor=BlockRegistry(config.mitigation.block_ttl_s * 1000),
        outputStructType=BLOCK_SCHEMA, outputMode="Update", timeMode="EventTime")


def use_state_store(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def block_intervals(decisions: DataFrame, config: Settings = DEFAULT) -> DataFrame:
    """All block intervals per address: a session window whose gap is the block time.

    Works on tables and, in append mode, on streams; blocks are merged before the shuffle.
    """
    ttl = f"{config.mitigation.block_ttl_s} seconds"
    at = F.timestamp_millis(F.col("end_ms").cast("bigint"))
    return (decisions.filter("action = 'block'").withColumn("ts", at)
            .groupBy(F.session_window("ts", ttl).alias("w"), "ip").agg(F.count(F.lit(1)).alias("n_blocks"))
            .select("ip", F.unix_millis("w.start").alias("blocked_from_ms"),
                    F.unix_millis("w.end").alias("blocked_until_ms"), "n_blocks"))
