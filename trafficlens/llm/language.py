"""Language by rank-order profiles of letter n-grams.

A profile lists the most frequent n-grams (1 to 3 letters, words padded with blanks) of a language in
the order of their frequency; so does every document. The distance of a document to a profile is how
far its n-grams are out of place there, an n-gram that the profile lacks counting as far as can be.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.text import fold, whole
from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 5, 0
TOP = 300
# bound of the sample that a profile is made from: rows of each language
SAMPLE_ROWS = 500
UNDETERMINED = "und"
# stands for everything between words; not 0, so that a blank before a letter counts in the code of an n-gram
BLANK = 1


def letters() -> np.ndarray:
    """For every code point its lower-case letter, or BLANK: not a letter."""
    table = np.full(0x110000, BLANK, np.int64)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def ranked(text: str, table: np.ndarray, top: int = TOP) -> np.ndarray:
    """Codes of the most frequent n-grams, the most frequent first; of equally frequent ones the smaller code."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.concatenate([[BLANK], table[points], [BLANK]])
    # blanks in a row are one blank
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    if len(codes) < 3:
        return np.empty(0, np.int64)
    pairs = (codes[:-1] << 21) | codes[1:]
    threes = (pairs[:-1] << 21) | codes[2:]
    # an n-gram holds blanks at its ends only, and not alone
    inner = threes[codes[1:-1] != BLANK]
    found, counts = np.unique(np.concatenate([codes[codes != BLANK], pairs, inner]), return_counts=True)
    return found[np.lexsort((found, -counts))[:top]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and n-gram the count in these texts; a partition's own n-grams only, added up by Spark."""
    table = letters()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            codes = ranked(text, table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(TOP - np.arange(len(codes)))],
                                             ["lang", "gram", "points"])


def profiles(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Per language its n-grams, the most frequent first.

    Made from at most `sample_rows` texts of each language, in the order of the MD5 of the id; each text gives its
    ranking, and rankings are added up, so a long text weighs no more than a short one. Texts count whole, however long.
    """
    name = F.md5(F.col("doc_id").cast("string").cast("binary"))
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)
                        & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    named = known.select("doc_id", "lang", name.alias("_md5"))
    # one row per language; the first eight digits then leave about four times the rows wanted, so that only those meet in the window
    sizes = named.groupBy("lang").agg(F.count(F.lit(1)).alias("_rows"))
    thinned = (named.join(sizes, "lang").filter(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("double") <= F.lit(4.0 * 2**32) * sample_rows / F.col("_rows")))
    order = Window.partitionBy("lang").orderBy("_md5", "doc_id")
    sample = materialize(thinned.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= sample_rows)
                         .select("doc_id", "lang").distinct(), "sample")
    texts = known.join(sample, ["doc_id", "lang"], "left_semi").select("lang", "text")
    counted = texts.mapInArrow(_counted, "lang string, gram bigint, points bigint").groupBy("lang", "gram").agg(F.sum("points").alias("points"))
    best = Window.partitionBy("lang").orderBy(F.desc("points"), "gram")
    top = counted.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= TOP)
    found: dict[str, list[int]] = {}
    # TOP rows for each language
    for row in top.select("lang", "_r", "gram").orderBy("lang", "_r").toLocalIterator():
        found.setdefault(row[0], []).append(row[2])
    return {lang: np.array(grams, np.int64) for lang, grams in sorted(found.items())}


def _predicted(known: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, names = letters(), list(known)
        sorted_grams = {lang: np.sort(grams) for lang, grams in known.items()}
        places = {lang: np.argsort(grams) for lang, grams in known.items()}
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                own = ranked(text.as_py(), table)
                if not len(own) or not names:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                distances = []
                for lang in names:
                    grams, order = sorted_grams[lang], places[lang]
                    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                    away = np.where(grams[at] == own, np.abs(order[at] - np.arange(len(own))), TOP)
                    distances.append(away.sum() / (TOP * len(own)))
                best = int(np.argmin(distances))
                langs.append(names[best])
                scores.append(1.0 - min(1.0, distances[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])
    return run


def languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Profiles are learned from rows with crc32(doc_id as text) mod 5 other than 0 and a language. Null texts and texts
    without a letter are `und` with score 0, as all texts are if nothing can be learned. Of equally near
    languages the first by name is given. The score is 1 less the distance as a share of the largest one. Other columns are ignored.
    """
    known = profiles(docs, sample_rows)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    found = base.mapInArrow(_predicted(known), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
