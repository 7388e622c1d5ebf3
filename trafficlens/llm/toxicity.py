"""Toxicity by compression distance.

Two zstandard dictionaries are made from a bounded sample of labelled texts. Both begin with what
zstandard's trainer picks from ordinary text; each ends with the segments that set its class apart (word
starts found in far more texts of that class than of the other). A window is a word between two fixed
pieces that both dictionaries hold, so its length tells what the word costs; a window that is shorter
with the toxic dictionary than with the ordinary one is evidence. Runs of 64, 256, 1,024 ... words and the whole text
are weighed by the bytes that their distinct words save, beside the square root of the run's length; the heaviest run
counts, less what chance adds as a text grows, so a passage weighs nearly the same in a short and in a long text and a repeated
line weighs no more than one. Isotonic calibration on other labelled rows turns that into a probability.
Words repeat, so a task works out each distinct window once.
"""

from __future__ import annotations

import math
import random
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trafficlens.llm.calibration import isotonic, with_probability
from trafficlens.llm.text import fold, whole
from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD_OUT = 4, 2
CUT = 0.3
# bound of the sample that the dictionaries are made from: rows of each class, and code points of a row; of a longer
# text a piece of that size is taken, from a place that the hash of the id names
SAMPLE_ROWS = {1: 3_000, 0: 6_000}
SAMPLE_CHARS = 20_000
BASE_BYTES, CONTRAST_BYTES = 24_000, 4_000
SEGMENT = (5, 12)
# zstandard indexes no segment at the very end of a dictionary, and a repeated one surely
REPEATS = 3
LEVEL = 5
# bytes that a word saves by chance; words that are added to those of every run
NOISE, SMOOTH = 1, 50
# words of the shortest run, and what the heaviest of twice as many runs weighs more by chance
RUN, GROWTH = 64, 0.02
# steps of the evidence that calibration tells apart
STEPS = 32
# pairs of pieces that are tried around the words, and texts of each class that they are tried on
FRAMES, TRIED_ON = 6, 200
# distinct words that a task remembers
REMEMBERED = 120_000


def _contrast(of: Counter, rows: int, other: Counter, other_rows: int) -> bytes:
    """Segments sure to be several times as frequent in one class, the surest last (nearest to the window)."""
    found = {}
    for segment, count in of.items():
        if count < max(4, 0.02 * rows):
            continue
        a, b = count + 0.5, other[segment] + 0.5
        ratio = math.log(a / rows) - math.log(b / other_rows)
        sure = ratio - 1.5 * math.sqrt(1 / a + 1 / b)
        if sure > math.log(5):
            found[segment] = sure * math.sqrt(count)
    # of a segment and its longer forms that are as frequent, the longest; a form of a kept one adds nothing
    longer = {}
    for segment in found:
        for size in range(SEGMENT[0], len(segment)):
            longer[segment[:size]] = max(longer.get(segment[:size], 0), of[segment])
    kept: list[str] = []
    for segment in sorted((s for s in found if longer.get(s, 0) < 0.9 * of[s]), key=len):
        if not any(segment.startswith(k) for k in kept):
            kept.append(segment)
    text = "".join(sorted(kept, key=found.__getitem__))
    return text.encode()[-CONTRAST_BYTES:]


def _unlike(texts: list[str]) -> list[str]:
    """One text of each group of near copies, by two minima over hashed runs of three words: a text with
    many copies would make its own words look typical of its class."""
    seen: set[tuple[int, int]] = set()
    kept = []
    for text in texts:
        words = text.lower().split()
        runs = [" ".join(words[k:k + 3]).encode() for k in range(max(1, len(words) - 2))]
        keys = {(seed, min(zlib.crc32(r, seed) for r in runs)) for seed in (1, 2)}
        if not keys & seen:
            kept.append(text)
        seen |= keys
    return kept


def train_dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Contents of the (ordinary, toxic) dictionaries."""
    ordinary, toxic = _unlike(ordinary), _unlike(toxic)

    def segments(texts: list[str]) -> Counter:
        words = Counter(w for t in texts for w in {*t.lower().split()})
        found: Counter = Counter()
        for word, count in words.items():
            word = " " + word
            for size in range(SEGMENT[0], min(len(word), SEGMENT[1]) + 1):
                found[word[:size]] += count
        return found

    pieces = [w for t in ordinary for w in _runs(t, 3) if len(w) >= 8]
    random.Random(0).shuffle(pieces)
    try:
        base = zstandard.train_dictionary(BASE_BYTES + 8_000, pieces[:60_000]).as_bytes()[-BASE_BYTES:]
    except zstandard.ZstdError:
        base = b" ".join(pieces)[-BASE_BYTES:]
    plain, bad = segments(ordinary), segments(toxic)
    rows, bad_rows = max(len(ordinary), 1), max(len(toxic), 1)
    ends = [_contrast(plain, rows, bad, bad_rows) * REPEATS, _contrast(bad, bad_rows, plain, rows) * REPEATS]
    # equal lengths, so that the common part is as far from a window in both
    longest = max(map(len, ends))
    middle = base[len(base) // 2:]
    return tuple(base + (middle * (longest // max(len(middle), 1) + 1))[:longest - len(e)] + e for e in ends)


def _runs(text: str, size: int) -> list[bytes]:
    words = text.lower().encode().split()
    return [b" ".join(words[k:k + size]) for k in range(0, len(words), size)]


class Windows:
    """Bytes that the toxic dictionary saves, window by window."""

    def __init__(self, ordinary: bytes, toxic: bytes, frame: int = 0):
        """frame: which of FRAMES pairs of pieces of the common part stands around each word."""
        self.plain, self.bad = self._compressor(ordinary), self._compressor(toxic)
        step = BASE_BYTES // (2 * FRAMES)
        end, half = BASE_BYTES - 36 - frame * step, BASE_BYTES // 2 - frame * step
        self.before, self.after = ordinary[max(0, end - 64):end] + b" ", b" " + ordinary[half:half + 24]
        self.known: dict[bytes, int] = {}

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def saved(self, word: bytes) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            window = self.before + word + self.after
            found = self.known[word] = max(0, len(self.plain.compress(window)) - len(self.bad.compress(window)) - NOISE)
        return found

    def evidence(self, text: str) -> float:
        words = text.lower().encode().split()
        hits = [(place, word, gain) for place, (word, gain) in enumerate(zip(words, map(self.saved, words))) if gain]
        if not hits:
            return 0.0
        size, best = RUN, 0.0
        while size < len(words):
            best = max(best, heaviest(hits, size) / math.sqrt(size + SMOOTH))
            size *= 4
        best = max(best, heaviest(hits, len(words)) / math.sqrt(len(words) + SMOOTH))
        best -= GROWTH * math.log2(max(1.0, len(words) / RUN))
        return round(STEPS * max(0.0, best)) / STEPS


def heaviest(hits: list[tuple[int, bytes, int]], size: int) -> int:
    """Most that the distinct words of a run of so many words save; hits: place, word, bytes saved, by place."""
    inside: Counter = Counter()
    total = best = first = 0
    for place, word, gain in hits:
        while hits[first][0] <= place - size:
            _, left, less = hits[first]
            inside[left] -= 1
            total -= 0 if inside[left] else less
            first += 1
        total += 0 if inside[word] else gain
        inside[word] += 1
        best = max(best, total)
    return best


def _best_frame(contents: tuple[bytes, bytes], ordinary: list[str], toxic: list[str]) -> int:
    """The frame under which evidence tells the classes apart best, by the share of pairs in order."""
    def in_order(frame: int) -> float:
        windows = Windows(*contents, frame)
        plain, bad = (np.array([windows.evidence(t) for t in texts[:TRIED_ON]]) for texts in (ordinary, toxic))
        return float((bad[:, None] > plain).mean() - (bad[:, None] < plain).mean()) if len(plain) and len(bad) else 0.0

    return max(range(FRAMES), key=in_order)


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts: dict[int, list[str]] = {0: [], 1: []}
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            texts[label].append(text)
    # rows arrive in any order; the dictionaries must not depend on it
    for found in texts.values():
        found.sort(key=lambda t: zlib.crc32(t.encode()))
    contents = train_dictionaries(texts[0], texts[1])
    frame = _best_frame(contents, texts[0], texts[1])
    yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.binary()) for c in contents], pa.array([frame], pa.int32())], ["ordinary", "toxic", "frame"])


def _evidence(ordinary: bytes, toxic: bytes, frame: int, kept: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(ordinary, toxic, frame)
        for batch in batches:
            found = [windows.evidence(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.select(kept).append_column(name, pa.array(found, pa.float64()))
    return run


def measured(docs: DataFrame, contents: tuple[bytes, bytes, int], kept: list[str], name: str) -> DataFrame:
    """Some columns of the rows and, under the given name, their evidence; stored. Texts are not shuffled."""
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(name, T.DoubleType())])
    return materialize(docs.mapInArrow(_evidence(*contents, kept, name), schema), "evidence")


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label: one row per labelled id; of several labels the largest, null labels and ids left out."""
    return labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, int]:
    """Dictionaries and frame from at most SAMPLE_ROWS rows of each class, taken in the order of the MD5 of the id.
    A third of the labelled rows outside the held-out ones is left for calibration."""
    known = (labelled(labels, "toxic").filter((fold("doc_id", FOLDS) != HELD_OUT) & ~_calibrates())
             .select("doc_id", (F.col("label") > 0).cast("int").alias("label"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("_md5")))
    sizes = {r[0]: r[1] for r in known.groupBy("label").agg(F.count(F.lit(1))).collect()}
    order = Window.partitionBy("label").orderBy("_md5", "doc_id")
    # the first eight digits leave about four times the rows wanted, so that only those meet in the window
    share = F.when(F.col("label") == 1, _share(1, sizes)).otherwise(_share(0, sizes))
    bound = F.when(F.col("label") == 1, SAMPLE_ROWS[1]).otherwise(SAMPLE_ROWS[0])
    sample = (known.filter(F.conv(F.substring("_md5", 1, 8), 16, 10).cast("bigint") <= share)
              .withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max(SAMPLE_ROWS.values()))
              .filter(F.col("_r") <= bound).select("doc_id", "label"))
    # at most the sum of SAMPLE_ROWS
    start = 1 + F.pmod(F.xxhash64("doc_id"), F.greatest(F.char_length("text") - SAMPLE_CHARS + 1, F.lit(1)))
    texts = (docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(sample), "doc_id")
             .select("label", F.col("text").substr(start.cast("int"), F.lit(SAMPLE_CHARS)).alias("text")))
    # the sample may hold ids that repeat in the documents; their rows are few
    found = texts.repartition(1).mapInArrow(_trained, "ordinary binary, toxic binary, frame int").first()
    return (b"", b"", 0) if found is None else (bytes(found[0]), bytes(found[1]), found[2])


def _share(label: int, sizes: dict[int, int]) -> int:
    return int(min(1.0, 4 * SAMPLE_ROWS[label] / max(sizes.get(label, 0), 1)) * (2**32 - 1))


def _calibrates():
    return F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / FOLDS) % 3 == 0


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learned from rows with crc32(doc_id as text) mod 4 other than 2. Null texts count as empty; texts
    without words have no evidence, and the score of that. Texts of any length are weighed whole. Rows that repeat an id
    are scored on their own. Without labels every score is 0.5; an empty table gives none. Other columns are ignored.
    """
    rows = measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text")), fit(docs, labels), ["doc_id"], "_evidence")
    scored = with_probability(rows, "_evidence", _points(rows, labels), "score")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"), F.col("_evidence").alias("evidence"))


def _points(rows: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Calibration from the labelled rows kept for it: one group per step of the evidence."""
    known = labelled(labels, "toxic").filter((fold("doc_id", FOLDS) != HELD_OUT) & _calibrates())
    step = F.least("_evidence", F.lit(100.0))
    groups = (rows.select("doc_id", "_evidence").join(known, "doc_id").groupBy(step.alias("e"))
              .agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("label") > 0).cast("int")).alias("hits"))).collect()
    return isotonic([g[0] for g in groups], [g[1] for g in groups], [g[2] for g in groups])


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; one without any evidence always stays. Texts are written once beside their evidence, never shuffled."""
    name = "_evidence"
    while name in docs.columns:
        name = "_" + name
    rows = measured(docs, fit(docs, labels), docs.columns, name)
    x, y = _points(rows.select("doc_id", F.col(name).alias("_evidence")), labels)
    # the probability never falls, so the cut on it is a cut on the evidence
    toxic = [float(v) for v in np.arange(1, 100 * STEPS + 1) / STEPS if np.interp(v, x, y) >= CUT]
    return rows.filter(F.col(name) < toxic[0] if toxic else F.lit(True)).select(*docs.columns)
