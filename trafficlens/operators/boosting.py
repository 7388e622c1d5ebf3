"""Boosted trees on histograms.

Features are cut once at quantiles into at most BINS bins, so a session becomes a row of bytes. Sessions are
packed into blocks; a level of a tree is one pass over them, which sums gradients by (node, feature, bin) in
every task. The sums of a feature are added up in one task, which looks for its best cut of every node; the driver sees
those few numbers only, never sums, and sends the best cut of all features back. How many partitions there are follows from
the sessions, not from the files: one of at most PART_ROWS needs no shuffle at all.

Gradients are whole multiples of 2^-SCALE_BITS, so sums are exact: the trees depend neither on how rows are
partitioned nor on the order of additions. Margins are kept beside the blocks; every CHECKPOINT_TREES trees they
are written to the shared folder, which bounds what a lost executor has to repeat.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.config import ModelSettings
from trafficlens.operators.skew import materialize, shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 256
SCALE_BITS = 30
# added to the curvature of a leaf, and least gain of a cut
SMOOTH, LEAST_GAIN = 1.0, 1e-9
BLOCK_ROWS = 65_536
# sessions of a partition, about: each sends one table of sums per level if there are several
PART_ROWS = 262_144
# tasks that add up the sums of features
MOST_REDUCERS = 16
CHECKPOINT_TREES = 50
NODE_SCHEMA = "tree int, node int, feature int, threshold double, value double, gain double"


@dataclass(frozen=True)
class BoostedModel:
    """Trees in heap order: node k has children 2k + 1 and 2k + 2, leaves have feature -1. A row goes left if its value is at most the threshold."""

    names: tuple[str, ...]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def importances(self) -> dict[str, float]:
        """Share of every feature in the gain of all cuts."""
        total = np.zeros(len(self.names))
        inner = self.feature >= 0
        np.add.at(total, self.feature[inner], self.gain[inner])
        return dict(zip(self.names, (total / (total.sum() or 1.0)).tolist()))

    def margins(self, points: np.ndarray) -> np.ndarray:
        total = np.full(len(points), self.base)
        rows = np.arange(len(points))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(points), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                split = feature[at]
                right = points[rows, np.maximum(split, 0)] > threshold[at]
                at = np.where(split >= 0, 2 * at + 1 + right, at)
            total += value[at]
        return total


# --- blocks ------------------------------------------------------------------------------------------

def bin_edges(train: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct quantiles of every feature, in one pass: at most bins - 1 of them each."""
    # as SQL text: thousands of literals one by one would take longer than the pass itself
    shares = "array(" + ", ".join(f"{k / bins!r}D" for k in range(1, bins)) + ")"
    found = train.selectExpr(*[f"percentile_approx({n}, {shares}, {20 * bins}) as {n}" for n in names]).first()
    return [np.unique(np.array(found[n] if found[n] is not None else [], np.float64)) for n in names]


def binned(points: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bin k of a feature holds the values above edge k - 1 and not above edge k."""
    return np.stack([np.searchsorted(e, points[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.uint8)


def _packed(edges: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            for start in range(0, len(batch), BLOCK_ROWS):
                part = slice(start, start + BLOCK_ROWS)
                columns = [binned(points[part], edges), batch.column(1).to_numpy()[part].astype(np.uint8), batch.column(2).to_numpy()[part].astype(np.uint64)]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["x", "y", "key"])
    return run


def _joined(rows: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of a partition, small ones put together: a batch of a thin file may hold a few rows only."""
    held, size = [], 0

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, key = (b"".join(r[n] for r in held) for n in ("x", "y", "key"))
        return np.frombuffer(x, np.uint8).reshape(len(y), -1), np.frombuffer(y, np.uint8), np.frombuffer(key, np.uint64)

    for row in rows:
        if held and size + len(row["y"]) > BLOCK_ROWS:
            yield block()
            held, size = [], 0
        held.append(row)
        size += len(row["y"])
    if held:
        yield block()


def _drawn(key: np.ndarray, tree: int, share: float) -> np.ndarray:
    """Rows of a tree's subsample: by a hash of row and tree, so the draw repeats anywhere."""
    h = key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) < np.uint64(min(share * 2.0**64, 2.0**64 - 4096))


# --- trees -------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Cuts:
    """A tree on bins: feature (-1: leaf), the last bin that goes left, and the value of every node."""

    feature: np.ndarray
    last: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Cuts:
        size = (1 << (depth + 1)) - 1
        return cls(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size))

    def places(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Node of every row after that many levels."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(levels):
            split = self.feature[at]
            right = x[rows, np.maximum(split, 0)] > self.last[at]
            at = np.where(split >= 0, 2 * at + 1 + right, at)
        return at


def level_sums(x: np.ndarray, y: np.ndarray, margin: np.ndarray, drawn: np.ndarray, cuts: Cuts, level: int) -> np.ndarray:
    """Gradient, curvature and rows by (node of the level, feature, bin), as whole numbers."""
    first, width = (1 << level) - 1, 1 << level
    x, y, margin = x[drawn], y[drawn], margin[drawn]
    at = cuts.places(x, level) - first
    live = at >= 0
    x, at = x[live], at[live]
    p = 1 / (1 + np.exp(-margin[live]))
    scale = float(1 << SCALE_BITS)
    features = x.shape[1]
    cell = ((at[:, None] * features + np.arange(features)) * BINS + x).ravel()
    size = width * features * BINS
    sums = [np.bincount(cell, np.repeat(np.rint(v * scale), features), size) for v in (y[live] - p, p * (1 - p))]
    return np.stack([*sums, np.bincount(cell, minlength=size)]).astype(np.int64).reshape(3, width, features, BINS)


def feature_cuts(feature: int, sums: np.ndarray, level: int, rate: float) -> list[tuple]:
    """The best cut of one feature for every node of the level that has rows: (node, gain, feature, last bin, values of
    the node and of its children). Without a cut that gains, the gain is 0."""
    scale = float(1 << SCALE_BITS)

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + SMOOTH)

    def value(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return rate * g / (h + SMOOTH)

    left_g, left_h, left_n = np.cumsum(sums, axis=-1)
    whole_g, whole_h, whole_n = (a[:, -1:] for a in (left_g, left_h, left_n))
    right_g, right_h = (whole_g - left_g) / scale, (whole_h - left_h) / scale
    left_g, left_h, whole_g, whole_h = (a / scale for a in (left_g, left_h, whole_g, whole_h))
    gains = score(left_g, left_h) + score(right_g, right_h) - score(whole_g, whole_h)
    gains[(left_n == 0) | (left_n == whole_n)] = -np.inf
    found, at = [], gains.argmax(axis=1)
    for k in np.flatnonzero(whole_n[:, 0]).tolist():
        b = int(at[k])
        gain = float(gains[k, b])
        values = [float(value(g[k, c], h[k, c])) for g, h, c in ((whole_g, whole_h, 0), (left_g, left_h, b), (right_g, right_h, b))]
        found.append(((1 << level) - 1 + k, gain if gain > LEAST_GAIN else 0.0, feature, b, *values))
    return found


def best_cuts(found: Iterable[tuple]) -> list[tuple]:
    """Of every node the cut with the largest gain, of equal ones that of the first feature."""
    best: dict[int, tuple] = {}
    for cut in found:
        if cut[0] not in best or (-cut[1], cut[2]) < (-best[cut[0]][1], best[cut[0]][2]):
            best[cut[0]] = cut
    return list(best.values())


def with_cuts(cuts: Cuts, found: Iterable[tuple], level: int) -> Cuts:
    """The tree one level deeper."""
    feature, last, value, gain = (a.copy() for a in (cuts.feature, cuts.last, cuts.value, cuts.gain))
    for at, gained, f, b, own, left, right in best_cuts(found):
        if level == 0:
            value[0] = own
        if gained:
            feature[at], last[at], gain[at] = f, b, gained
            value[2 * at + 1], value[2 * at + 2] = left, right
    return Cuts(feature, last, value, gain)


def _level_cuts(sums: RDD, level: int, rate: float) -> list[tuple]:
    """Best cuts of the nodes of a level, a few numbers from every task."""
    def looked(rows: Iterator[tuple[int, np.ndarray]]) -> list[tuple]:
        return best_cuts(cut for f, table in rows for cut in feature_cuts(f, table, level, rate))

    def features(rows: Iterator[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
        total = None
        for row in rows:
            total = row if total is None else total + row
        return iter(()) if total is None else ((f, np.ascontiguousarray(total[:, :, f])) for f in range(total.shape[2]))

    parts = sums.getNumPartitions()
    tables = sums.mapPartitions(features)
    if parts > 1:
        tables = tables.reduceByKey(np.add, min(parts, MOST_REDUCERS))
    return tables.mapPartitions(looked).collect()


def fit(train: DataFrame, names: Sequence[str], m: ModelSettings, label: str = "label", key: str = "session_id") -> BoostedModel:
    """Trees that lower the logistic loss of the label, step by step.

    Every tree sees a share `boost_subsample` of the rows, drawn by a hash of the key. Rows need no order; a feature with one value is never cut.
    """
    edges = bin_edges(train, names)
    rows = train.select(F.array(*[F.col(n).cast("double") for n in names]).alias("x"), F.col(label).cast("int").alias("y"), F.xxhash64(key, F.lit(m.seed)).alias("key"))
    blocks = materialize(rows.mapInArrow(_packed(edges), "x binary, y binary, key binary"), "blocks")
    parts = -(-(blocks.agg(F.sum(F.octet_length("y"))).first()[0] or 0) // PART_ROWS) or 1
    stored = blocks.coalesce(parts).rdd.mapPartitions(_joined).persist(StorageLevel.MEMORY_AND_DISK)
    total, hits = stored.map(lambda b: (len(b[1]), int(b[1].sum()))).fold((0, 0), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    if not total:
        raise ValueError("no sessions to fit on")
    share = min(max(hits / total, 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    shared_dir(train.sparkSession)  # margins are checkpointed there
    # margins travel in step with their blocks
    state = stored.map(lambda b: (*b, np.full(len(b[1]), base)))
    depth, made, kept = m.boost_depth, [], []
    for tree in range(m.boost_trees):
        cuts = Cuts.empty(depth)
        for level in range(depth):
            sums = state.map(lambda b, c=cuts, t=tree, k=level, s=m.boost_subsample: level_sums(b[0], b[1], b[3], _drawn(b[2], t, s), c, k))
            deeper = with_cuts(cuts, _level_cuts(sums, level, m.boost_rate), level)
            if (deeper.feature == cuts.feature).all():
                cuts = deeper
                break
            cuts = deeper
        made.append(cuts)
        moved = state.map(lambda b, c=cuts, d=depth: (b[0], b[1], b[2], b[3] + c.value[c.places(b[0], d)])).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % CHECKPOINT_TREES == 0:
            moved.checkpoint()
            moved.count()
        state = moved
        # the margins before the last are needed no more once the next tree has been through
        kept.append(moved)
        if len(kept) > 2:
            kept.pop(0).unpersist()
    for held in (*kept, stored):
        held.unpersist()
    thresholds = [[float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(c.feature, c.last)] for c in made]
    return BoostedModel(tuple(names), base, np.array([c.feature for c in made]), np.array(thresholds), np.array([c.value for c in made]), np.array([c.gain for c in made]))


# --- scoring and storing -------------------------------------------------------------------------------

def probability(model: BoostedModel, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-shared.value.margins(np.array(x.tolist())))))

    return score(F.array(*model.names))


def nodes(spark: SparkSession, model: BoostedModel) -> DataFrame:
    """The trees as rows: bounded by trees and depth."""
    rows = [(t, k, int(model.feature[t, k]), float(model.threshold[t, k]), float(model.value[t, k]), float(model.gain[t, k]))
            for t in range(len(model.feature)) for k in range(model.feature.shape[1])]
    return spark.createDataFrame(rows, NODE_SCHEMA)


def save(spark: SparkSession, model: BoostedModel, path: str) -> None:
    nodes(spark, model).write.mode("overwrite").parquet(f"{path}/nodes")
    spark.createDataFrame([(list(model.names), model.base, len(model.feature))], "names array<string>, base double, trees int").write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> BoostedModel:
    about = spark.read.parquet(f"{path}/about").first()
    table = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["tree", "node"])
    shape = (about["trees"], -1) if about["trees"] else (0, 0)
    arrays = [table[c].to_numpy().reshape(shape) for c in ("feature", "threshold", "value", "gain")]
    return BoostedModel(tuple(about["names"]), about["base"], *arrays)


def first_trees(model: BoostedModel, n: int) -> BoostedModel:
    return replace(model, feature=model.feature[:n], threshold=model.threshold[:n], value=model.value[:n], gain=model.gain[:n])
