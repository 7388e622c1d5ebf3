"""Isotonic calibration: scores to probabilities that never fall as the score rises."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def isotonic(scores: Sequence[float], rows: Sequence[float], positives: Sequence[float], prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Points (score, probability) of the non-decreasing fit to rows grouped by score, by pooling neighbours.

    Every point is drawn a little towards the overall rate (`prior` rows), so that no probability is exactly 0 or 1.
    Without rows the fit is 0.5 everywhere.
    """
    order = np.argsort(scores)
    total, hits = float(np.sum(rows)), float(np.sum(positives))
    if total == 0:
        return np.array([0.0]), np.array([0.5])
    rate = hits / total
    blocks: list[list[float]] = []
    for k in order:
        blocks.append([rows[k], positives[k], scores[k] * rows[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    x = np.array([s / n for n, _, s in blocks])
    y = np.array([(h + prior * rate) / (n + prior) for n, h, _ in blocks])
    return x, np.maximum.accumulate(y)


def with_probability(df: DataFrame, column: str, points: tuple[np.ndarray, np.ndarray], name: str) -> DataFrame:
    """Adds the calibrated probability of a score column; between two points it is drawn as a straight line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
            yield batch.append_column(name, pa.array(np.interp(scores, *points), pa.float64()))

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
