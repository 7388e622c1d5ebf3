"""Quality by kernel ridge regression on document statistics.

Random Fourier features approximate a Gaussian kernel over standardised statistics of a text. The
normal equations of the ridge fit are sums over rows: every partition adds up its own, few rows per
partition are shuffled and added, and a small system is solved once. The ridge strength is the one
with the least error across two halves, read off the halves' sums. Scores of each half by the fit on the
other half give the isotonic calibration.
"""

from __future__ import annotations

import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.calibration import isotonic, with_probability
from trafficlens.llm.text import fold, whole
from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 5, 0
CUT = 0.3
FEATURES = 256
WIDTH = 2.0
RIDGES = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
# rows of the normal equations that travel together
BLOCK = 32
SEED = 17
# classes of bytes: lower case, upper case, digit, white space, sentence marks, other marks, other bytes
MARKS = b".,;:!?'\"-()"
CLASSES = 7
STATISTICS = 18


def _byte_classes() -> np.ndarray:
    table = np.full(256, 6, np.int64)
    for b in range(128):
        c = chr(b)
        table[b] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 4 if b in MARKS else 5)
    return table


def statistics(text: str, classes: np.ndarray) -> list[float]:
    """Shares and logarithms that do not depend on the language's letters."""
    data = text.encode()
    counts = np.bincount(classes[np.frombuffer(data, np.uint8)], minlength=CLASSES) if data else np.zeros(CLASSES)
    size = max(len(data), 1)
    words = data.split()
    n = max(len(words), 1)
    seen = Counter(words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    ends = sum(w[-1] not in MARKS and not w[-1:].isalnum() and w[-1] < 128 for w in words)
    alone = sum(c for w, c in seen.items() if not w.isalnum() and len(w) == 1 and w[0] < 128)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    return [np.log1p(len(words)), np.log1p(len(data)), *(counts / size), float(lengths.mean()) / 10, float(lengths.std()) / 10,
            len(seen) / n, repeated / n, seen.most_common(1)[0][1] / n if words else 0.0, ends / n, alone / n,
            float((lengths <= 3).mean()), len(set(lines)) / len(lines)]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    classes = _byte_classes()
    for batch in batches:
        rows = [statistics(t.as_py(), classes) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, stats: one narrow row per document, stored, so that texts are read once."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    return materialize(base.mapInArrow(_statistics, "doc_id bigint, stats array<double>"), "stats")


class FourierFeatures:
    """cos(w x + b) of standardised statistics, w drawn from the kernel's spectrum; the last feature is constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES):
        draw = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.weights = draw.normal(size=(len(mean), features - 1)) / (WIDTH * np.sqrt(len(mean) / 4))
        self.shift = draw.uniform(0, 2 * np.pi, features - 1)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -8, 8)
        waves = np.sqrt(2 / len(self.shift)) * np.cos(x @ self.weights + self.shift)
        return np.hstack([waves, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _moments(training: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    spots = training.select(F.posexplode("stats").alias("p", "v"))
    found = {r[0]: (r[1], r[2]) for r in spots.groupBy("p").agg(F.avg("v"), F.stddev_pop("v")).collect()}
    return tuple(np.array([found.get(p, (0.0, 1.0))[k] for p in range(STATISTICS)]) for k in range(2))


def _partial(features: FourierFeatures):
    """Normal equations of a partition: per half and block of rows, [Z'Z | Z'y | y'y and n]."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = FEATURES
        sums = np.zeros((2, size, size + 2))
        for batch in batches:
            z = features(_matrix(batch, "stats"))
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            half = batch.column(batch.schema.get_field_index("half")).to_numpy(zero_copy_only=False)
            for h in (0, 1):
                a, b = z[half == h], y[half == h]
                sums[h, :, :size] += a.T @ a
                sums[h, :, size] += a.T @ b
                sums[h, 0, size + 1] += b @ b
        yield _blocks(sums)
    return run


def _blocks(sums: np.ndarray) -> pa.RecordBatch:
    keys = [(h, k) for h in (0, 1) for k in range(0, FEATURES, BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array([h * FEATURES + k for h, k in keys], pa.int32()),
                                       pa.array([sums[h, k:k + BLOCK].tobytes() for h, k in keys], pa.binary())], ["block", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            values = np.frombuffer(data)
            totals[block] = totals[block] + values if block in totals else values
    yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["block", "sums"])


def normal_equations(training: DataFrame, features: FourierFeatures) -> np.ndarray:
    """Sums per half: partitions first, then block by block; 2 x FEATURES / BLOCK rows reach the driver."""
    partial = training.mapInArrow(_partial(features), "block int, sums binary")
    sums = np.zeros((2, FEATURES, FEATURES + 2))
    # two levels, so that no task adds up the blocks of all partitions
    for by in (["block", F.spark_partition_id() % 16], ["block"]):
        partial = partial.withColumn("_by", F.hash(*by)).repartition("_by").select("block", "sums").mapInArrow(_added, "block int, sums binary")
    for block, data in partial.collect():
        h, k = divmod(block, FEATURES)
        sums[h, k:k + BLOCK] = np.frombuffer(bytes(data)).reshape(BLOCK, -1)
    return sums


def solve(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights of the fit on everything, and on each half; the ridge has the least error across halves."""
    gram, product, squares = sums[:, :, :FEATURES], sums[:, :, FEATURES], sums[:, 0, FEATURES + 1]

    def fitted(g: np.ndarray, p: np.ndarray, ridge: float) -> np.ndarray:
        return np.linalg.solve(g + ridge * np.eye(FEATURES), p)

    def error(ridge: float) -> float:
        total = 0.0
        for h in (0, 1):
            w = fitted(gram[h], product[h], ridge)
            total += w @ gram[1 - h] @ w - 2 * w @ product[1 - h] + squares[1 - h]
        return total

    ridge = min(RIDGES, key=error)
    return fitted(gram.sum(0), product.sum(0), ridge), fitted(gram[0], product[0], ridge), fitted(gram[1], product[1], ridge)


def _raw(features: FourierFeatures, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(features(_matrix(batch, "stats")) @ weights)], ["doc_id", "raw"])
    return run


def _crossed(features: FourierFeatures, weights: list[np.ndarray]):
    """Each row by the fit on the half that it is not in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = features(_matrix(batch, "stats"))
            half = batch.column(batch.schema.get_field_index("half")).to_numpy(zero_copy_only=False)
            raw = np.where(half == 0, z @ weights[1], z @ weights[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(raw, -1, 2), 3)), batch.column(batch.schema.get_field_index("label"))], ["raw", "label"])
    return run


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learned from rows with crc32(doc_id as text) mod 5 other than 0. Null texts count as empty and are
    scored from the statistics of the empty text. Rows that repeat an id are scored on their own; of several
    labels of an id the largest counts. Without labels every score is 0.5. Other columns are ignored.
    """
    stats = measured(docs)
    known = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg((F.max("quality") > 0).cast("int").alias("label")).filter(fold("doc_id", FOLDS) != HELD_OUT))
    half = F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % 2
    training = materialize(stats.join(known, "doc_id").select("stats", "label", half.cast("int").alias("half")), "training")
    features = FourierFeatures(*_moments(training))
    weights, *halves = solve(normal_equations(training, features))
    # at most 3,001 groups: scores of three digits between -1 and 2
    groups = (training.mapInArrow(_crossed(features, halves), "raw double, label int").groupBy("raw")
              .agg(F.count(F.lit(1)), F.sum("label"))).collect()
    points = isotonic([g[0] for g in groups], [g[1] for g in groups], [g[2] for g in groups])
    scored = with_probability(stats.mapInArrow(_raw(features, weights), "doc_id bigint, raw double"), "raw", points, "score")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
