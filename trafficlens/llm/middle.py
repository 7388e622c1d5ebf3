"""Fill-in-the-middle: documents cut at two token ranks and put together again in another order.

A text is a sequence of units (a run of ASCII letters, or any other code point). An indexable skip list
over its units finds the cuts: every link of an express lane carries how many units and how many code
points it passes over, so going down from the top lane, and along each while the units passed stay
within the rank, sums up the exact code-point offset of the rank in O(log n) steps. Which lanes a unit
is in is drawn from a hash of its rank, so a list needs no stored randomness and reruns agree.

Documents are independent of each other: no shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.text import whole

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# of 100 documents, how many are transformed, and of 100 transformed ones, how many start with the suffix
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = "1"
# one in so many units of a lane is in the lane above
SPREAD_BITS = 2
# characters of output in one Arrow batch
CHARS_AT_ONCE = 8_000_000
RESULT = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def unit_starts(points: np.ndarray) -> np.ndarray:
    """Offset of every unit of a text given as code points."""
    letter = ((points | 32) - np.uint32(97)) < 26
    start = np.ones(len(points), bool)
    start[1:] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start)


class SkipList:
    """Units in order, found by rank. Lane 0 links every unit to the next; a higher lane passes over several."""

    def __init__(self, widths: np.ndarray):
        """widths: code points of each unit."""
        n = len(widths)
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(widths, out=offsets[1:])
        ranks = np.arange(n + 1)
        # the draw of a node; the head of the list (rank 0) is in every lane
        draw = _mixed(ranks.astype(np.uint64))
        draw[0] = 0
        # per lane: unit width and code-point width of every link, and where each node stands in the lane below
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        inside = np.arange(n + 1)
        below = inside
        while True:
            self.lanes.append((np.diff(inside), np.diff(offsets[inside]), below))
            if len(inside) == 1:
                break
            mask = np.uint64((1 << (SPREAD_BITS * len(self.lanes))) - 1)
            below = np.flatnonzero((draw[inside] & mask) == 0)
            inside = inside[below]

    def offset(self, rank: int) -> int:
        """Code points before the unit of that rank (0 to the number of units)."""
        units = points = at = 0
        for unit_widths, point_widths, below in reversed(self.lanes):
            while at < len(unit_widths) and units + unit_widths[at] <= rank:
                units += int(unit_widths[at])
                points += int(point_widths[at])
                at += 1
            at = int(below[at])
        return points


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def transformed(text: str, name: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text; `name` seeds its choices."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts = unit_starts(points)
    n = len(starts)
    digest = hashlib.sha256(f"{SEED}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    if not text or h3 % 100 >= TRANSFORMED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    found = SkipList(np.diff(starts, append=len(points)))
    first, second = (found.offset(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, middle, after = text[:first], text[first:second], text[second:]
    if h4 % 100 < SUFFIX_FIRST:
        form, output = "spm", SUFFIX + after + PREFIX + before + MIDDLE + middle
    else:
        form, output = "psm", PREFIX + before + SUFFIX + after + MIDDLE + middle
    return n, form, first, second - first, output


def _transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    for batch in batches:
        seeds, texts = batch.column(1), batch.column(2)
        start, rows, size = 0, [], 0
        for k in range(len(batch)):
            rows.append(transformed(texts[k].as_py(), seeds[k].as_py()))
            size += len(rows[-1][4])
            if size >= CHARS_AT_ONCE or k == len(batch) - 1:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), *columns], ["doc_id", *names])
                start, rows, size = k + 1, [], 0


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Null texts count as empty: no units, plain. Texts that hold a mark stay plain, as do those that the draw
    leaves out; prefix_chars and middle_chars are null for plain ones. The draw depends on the id alone (a null id
    draws as the empty name), so repeated rows come out alike. Whole texts are cut, however long: a task holds some
    30 bytes a code point of one text. An empty table gives an empty table; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_name"), whole("text").alias("text"))
    return rows.mapInArrow(_transform, f"doc_id {kind}, {RESULT}")


def restored(output: Column | str, form: Column | str) -> Column:
    """The text again, from output and form: the marks are in no transformed text, so they cut it exactly."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = F.split(output, "<[PSM]>", -1)
    # the part before the first mark is empty
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def middle_digests(docs: DataFrame) -> DataFrame:
    """`fill_in_middle` with digests in place of texts: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    found = fill_in_middle(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                        F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


MIDDLE_SQL = """
with t as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
drawn as (
  select *, len(units) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(units) + 1) as r1, cast('0x' || substr(h, 9, 8) as bigint) % (len(units) + 1) as r2,
         cast('0x' || substr(h, 17, 8) as bigint) % 100 as h3, cast('0x' || substr(h, 25, 8) as bigint) % 100 as h4
  from t),
cut as (
  select *, array_to_string(units[1:least(r1, r2)], '') as a, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') as b,
         array_to_string(units[greatest(r1, r2) + 1:], '') as c,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 >= 90 then 'plain'
              when h4 < 20 then 'spm' else 'psm' end as form
  from drawn)
select doc_id, cast(n as bigint) as n, form, case when form <> 'plain' then cast(length(a) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(b) as bigint) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || c || '<M>' || b else '<S>' || c || '<P>' || a || '<M>' || b end) as output_sha256,
       sha256(t) as restored_sha256
from cut
"""
