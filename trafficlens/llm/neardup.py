"""Near duplicates by SimHash and anchor points.

Anchors are the words of a covering code of all 64 bits: the perfect Hamming code on 63 bits, the
last bit free, so every point is within 1 bit (the covering radius) of an anchor. Two fingerprints
at most `threshold` bits apart have a point half-way, and the anchor of that point is within
covering radius plus half the threshold, rounded up, of both. A fingerprint is therefore replicated
to every anchor that near (33 anchors for threshold 2, instead of some 650 within the whole threshold),
and pairs are compared per anchor. A point has at most 2,081 points within 2 bits, which bounds the
distinct fingerprints of an anchor at any size of the corpus. Inside an anchor only a spanning
forest of its links is given out, never all pairs.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.simhash import as_hex, fingerprints, shingled
from trafficlens.llm.text import repeated, row_key, whole
from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHECKS = 6
LENGTH = (1 << CHECKS) - 1
THRESHOLD = 2
WORDS = 3


def syndrome(fingerprint: Column) -> Column:
    """0 for code words; else the position (from 1) of the one bit that leads to the nearest code word."""
    found = F.lit(0)
    for j in range(CHECKS):
        mask = sum(1 << (p - 1) for p in range(1, LENGTH + 1) if p >> j & 1)
        found = found + (F.bit_count(fingerprint.bitwiseAND(F.lit(mask))) % 2) * (1 << j)
    return found


def anchor_offsets(threshold: int) -> list[tuple[int, int]]:
    """(syndrome, bits to flip) that lead from a point to all anchors within 1 + ceil(threshold / 2) bits."""
    radius = 1 + (threshold + 1) // 2
    free = -(1 << 63)
    found = []
    for weight in range(radius + 1):
        for places in combinations(range(1, LENGTH + 1), weight):
            position, mask = 0, 0
            for p in places:
                position ^= p
                mask |= 1 << (p - 1)
            found.append((position, mask))
            if weight < radius:
                found.append((position, mask + free))
    return found


def _forest(members: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links among these fingerprints connect."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= threshold
    label = np.arange(len(members))
    while True:
        lower = np.where(near, label[None, :], len(members)).min(axis=1)
        if (lower == label).all():
            break
        label = lower
    other = label != np.arange(len(members))
    return members[other], members[label[other]]


def _links(threshold: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            twos = starts[sizes == 2]
            a, b = values[twos], values[twos + 1]
            near = np.bitwise_count(a ^ b) <= threshold
            left, right = [a[near]], [b[near]]
            for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
                x, y = _forest(values[start:start + size], threshold)
                left.append(x)
                right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side).astype(np.int64)) for side in (left, right)], ["a", "b"])
    return link


def linked(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links."""
    spark: SparkSession = distinct.sparkSession
    # a fixed table: 2,081 rows for threshold 2
    offsets = F.broadcast(spark.createDataFrame(anchor_offsets(threshold), "_s int, _mask bigint"))
    anchored = (distinct.select("fingerprint", syndrome(F.col("fingerprint")).cast("int").alias("_s")).join(offsets, "_s")
                .select(F.col("fingerprint").bitwiseXOR(F.col("_mask")).alias("_anchor"), "fingerprint"))
    met = anchored.groupBy("_anchor").agg(F.collect_list("fingerprint").alias("members")).filter(F.size("members") > 1)
    return met.select("members").mapInArrow(_links(threshold), "a bigint, b bigint").distinct()


def grouped(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(prints, classes): rows (doc_id, _id, _text, copies, fingerprint) and (fingerprint, root)."""
    base = docs.select("doc_id", whole("text").alias("text"))
    base = base.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    keys = ["doc_id", "_id", "_text"]
    prints = materialize(fingerprints(shingled(base, F.col("text"), words, keys), keys), "prints")
    distinct = materialize(prints.select("fingerprint").distinct(), "distinct")
    roots = components(linked(distinct, threshold)).withColumnsRenamed({"node": "fingerprint", "root": "_root"})
    classes = distinct.join(roots, "fingerprint", "left").select("fingerprint", F.coalesce("_root", "fingerprint").alias("root"))
    return prints, materialize(classes, "classes")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id.

    Texts without words have fingerprint 0 and are linked like any other; null texts count as empty. Documents
    with null ids get the smallest id of their component like the rest, null if there is none. Rows that
    repeat (doc_id, text) come out as often. Other columns are ignored.
    """
    prints, classes = grouped(docs, threshold, words)
    # many documents may share one fingerprint, and many fingerprints one root: sum up before each join
    firsts = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("_first"))
    found = classes.join(firsts, "fingerprint")
    smallest = found.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = materialize(found.join(smallest, "root").select("fingerprint", "component_id"), "named")
    rows = prints.select("doc_id", "fingerprint", "copies").join(named, "fingerprint")
    return repeated(rows.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id", "copies"), "copies")


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """The document with the smallest id of every component, with all its columns (null ids come last)."""
    prints, classes = grouped(docs, threshold, words)
    firsts = prints.groupBy("fingerprint").agg(F.min(mine()).alias("_first"))
    return rows_of_firsts(docs, classes.join(firsts, "fingerprint").groupBy("root").agg(F.min("_first").alias("_k")))


def mine() -> Column:
    """A row in the order in which rows of a component are kept: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_text").alias("t"))


def rows_of_firsts(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows that the structs _k name, with all their columns, one for rows that repeat."""
    kept = firsts.select(F.col("_k.i").alias("_id"), F.col("_k.t").alias("_text"))
    # whole rows travel as one column, so that no name of theirs clashes
    rows = docs.select(F.struct("*").alias("_row"), *row_key(F.col("doc_id"), whole("text"))).join(kept, ["_id", "_text"], "left_semi")
    same = Window.partitionBy("_id", "_text").orderBy("_id")
    return rows.withColumn("_r", F.row_number().over(same)).filter("_r = 1").select("_row.*")
