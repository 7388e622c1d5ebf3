"""Sources mixed to target weights along a time-varying curriculum.

Targets: sources share all words by weight; a source gives at most `limit` times its words, and what
that leaves over goes to the others by weight. Positions: the weight of a source changes linearly
over the training; its integral is the demand of the source up to a moment, and inverting it gives
the moment at which a document, by the words of its source before it, is due. Documents are then
range-sorted by that moment.

The order inside a source is the MD5 of the id and the text, so ranges of it cut a source of any size into even
pieces, null and repeated ids included: sums per piece give each piece its offset, and no task holds a whole source.
All of that runs on narrow rows; whole rows move twice, to their moments and into the training order.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.text import WORD, row_key, whole
from trafficlens.operators.skew import materialize, scratch

WEIGHTS = (5, 2, 1)
# change of a source's weight from start to end, as a share of its mean: heavy sources fade, light ones grow
TILTS = (-0.5, 0.0, 0.5)
LIMIT = 3
# rows in one ordered piece of a source, on average
PIECE_ROWS = 1_000


def word_count(text: Column | str) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, tilts: Sequence[float] = TILTS,
                   limit: int = LIMIT) -> DataFrame:
    """source, source_size, target, tilt from rows (source, source_size), one per source.

    With the sources sorted by words per weight, those that stop at their limit come first: a source
    does if its share of what the ones before it left would exceed the limit. All sums are whole
    numbers, so the result does not depend on the order of additions.
    """
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1

    def cycled(values: Sequence) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (rank % len(values) + 1).cast("int"))

    ranked = sizes.select("source", "source_size", cycled(list(weights)).cast("bigint").alias("_w"), cycled(list(tilts)).alias("tilt"))
    by_room = [F.col("source_size") / F.col("_w"), F.asc_nulls_last("source")]
    before = Window.orderBy(*by_room).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()

    def after_earlier(value: Column) -> tuple[Column, Column]:
        return F.sum(value).over(everything), F.coalesce(F.sum(value).over(before), F.lit(0))

    words, given = after_earlier(F.col("source_size"))
    weight, used = after_earlier(F.col("_w"))
    shared = (ranked.withColumn("_left", words - limit * given).withColumn("_weights", weight - used)
              .withColumn("_full", limit * F.col("source_size") * F.col("_weights") <= F.col("_w") * F.col("_left")))
    open_weights = F.when(~F.col("_full"), F.col("_weights"))
    shared = (shared.withColumn("_open", F.max(open_weights).over(everything))
              .withColumn("_rest", F.max_by("_left", open_weights).over(everything)))
    return shared.select("source", "source_size", "tilt",
                         F.when(F.col("_full"), (limit * F.col("source_size")).cast("double"))
                         .otherwise(F.col("_w") * F.col("_rest").cast("double") / F.col("_open")).alias("target"))


def due(words_before: Column, target: Column, tilt: Column) -> Column:
    """Moment in 0..1 at which the demand of a source reaches `words_before`: demand(t) = target * (t + tilt * (t * t - t))."""
    share = words_before / target
    bent = ((tilt - 1) + F.sqrt((F.lit(1) - tilt) * (F.lit(1) - tilt) + F.lit(4) * tilt * share)) / (F.lit(2) * tilt)
    return F.when(target > 0, F.when(tilt == 0, share).otherwise(bent))


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size and the place in the order of the source, stored; and further columns."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(whole("text").cast("binary")))
    return materialize(docs.select("doc_id", "source", word_count("text").alias("size"), F.md5(name.cast("binary")).alias("_order"), *more), "sizes")


def _piece(pieces: int) -> Column:
    return F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint") * pieces / (1 << 32)).cast("bigint")


def placed(sizes: DataFrame, limit: int = LIMIT, piece_rows: int = PIECE_ROWS, **targets) -> DataFrame:
    """Adds source_size, target, tilt and _start (words of the source before the row) to the rows of `sized`."""
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "sources")
    largest = totals.agg(F.max("_rows")).first()[0] or 1
    pieces = math.ceil(largest / piece_rows)
    sums = sizes.groupBy("source", _piece(pieces).alias("_piece")).agg(F.sum("size").alias("_words"))
    before = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_piece", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset"))
    shares = source_targets(totals, limit=limit, **targets)
    plan = (offsets.join(shares.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
            .select("_source", F.col("_piece").alias("_of"), "_offset", "source_size", "target", "tilt"))
    inside = (Window.partitionBy("source", "_piece").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    cut = sizes.withColumn("_piece", _piece(pieces))
    return (cut.withColumn("_start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_of")))
            .withColumn("_start", F.col("_start") + F.col("_offset"))
            .drop("_source", "_of", "_piece", "_offset", "_order"))


def _taken(copy: Column | int) -> Column:
    """Words that one pass over the source takes from a row: the target ends inside one row at most."""
    begin = F.lit(copy) * F.col("source_size") + F.col("_start") if isinstance(copy, int) else copy * F.col("source_size") + F.col("_start")
    return F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target").cast("bigint") - begin))


def mix(docs: DataFrame, limit: int = LIMIT, **options) -> DataFrame:
    """One row per document in training order: doc_id, size, source_size, target, taken, position.

    `taken` counts the words that the mix takes from the document, repeats counted; the document at
    which a target ends gives only the words still missing, so the taken words of a source are its target
    rounded down. `position` (0..1) is when its first copy is due, null if nothing is taken; such rows
    come last. Null texts have no words; a null source is a source of its own, the last. Rows with
    equal ids are ordered by size. Other columns are ignored.
    """
    found = placed(sized(docs), limit, **options)
    taken = sum((_taken(k) for k in range(1, limit)), _taken(0))
    position = F.when(F.col("taken") > 0, F.round(due(F.col("_start"), F.col("target"), F.col("tilt")), 9))
    return (found.withColumn("taken", taken).withColumn("position", position)
            .select("doc_id", "size", "source_size", "target", "taken", "position")
            .orderBy(F.asc_nulls_last("position"), "doc_id"))


def mixed(docs: DataFrame, limit: int = LIMIT, position: str | None = None, **options) -> DataFrame:
    """The training order itself: whole documents with all their columns, each as often as the mix
    takes it, range-sorted by the moment each copy is due. A copy of which less than half is taken is left out.

    `position` names a further column for the moment (0..1), which tells the order once rows are stored and read again.
    Null texts have no words; texts without words are taken once, when due. A null source is a source of its own, the last.
    Rows that repeat are taken each on its own; an empty table gives an empty table.
    """
    # rows that repeat stand beside each other in any order
    same = F.row_number().over(Window.partitionBy("_id", "_text").orderBy("_id"))
    with scratch(docs.sparkSession) as keep:
        found = placed(sized(docs, *row_key(F.col("doc_id"), whole("text"))), limit, **options)
        start = F.col("_start")
        copies = [F.when((_taken(k) * 2 >= F.col("size")) & ((F.col("size") > 0) | (k == 0)),
                         F.struct(due(k * F.col("source_size") + start, F.col("target"), F.col("tilt")).alias("m"))) for k in range(limit)]
        moments = found.select("_id", "_text", same.alias("_k"), F.filter(F.array(*copies), lambda c: c.isNotNull()).alias("_due"))
        moments = keep(materialize(moments.filter(F.size("_due") > 0), "moments"))
    # whole rows travel as one column, so that no name of theirs clashes
    rows = docs.select(F.struct("*").alias("_row"), *row_key(F.col("doc_id"), whole("text"))).withColumn("_k", same)
    chosen = rows.join(moments, ["_id", "_text", "_k"]).select("_row", "_id", F.explode("_due").alias("_due"))
    ordered = chosen.orderBy(F.asc_nulls_first("_due.m"), "_id")
    return ordered.select("_row.*", *([F.col("_due.m").alias(position)] if position else []))


MIX_SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size, md5(coalesce(cast(doc_id as varchar), '') || ' ' || md5(coalesce(text, ''))) as h
  from documents),
sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as r from sized group by source),
weighed as (
  select source, source_size, ([5, 2, 1])[r % 3 + 1] as w, ([-0.5, 0.0, 0.5])[r % 3 + 1]::double as tilt from sources),
shared as (
  select *, sum(source_size) over () - 3 * coalesce(sum(source_size) over o, 0) as rest,
         sum(w) over () - coalesce(sum(w) over o, 0) as ws
  from weighed window o as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
judged as (select *, 3 * source_size * ws <= w * rest as is_full from shared),
opened as (
  select max(ws) as open_ws, max_by(rest, ws) as open_rest from judged where not is_full),
targets as (
  select source, source_size, tilt,
         case when is_full then cast(3 * source_size as double) else cast(w as bigint) * cast(open_rest as double) / cast(open_ws as bigint) end as target
  from judged left join opened on true),
started as (
  select doc_id, source, size, cast(coalesce(sum(size) over (partition by source order by h, doc_id, size
         rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from sized),
took as (
  select s.doc_id, s.size, t.source_size, t.target, t.tilt, s.start,
         greatest(0, least(s.size, cast(floor(t.target) as bigint) - s.start))
         + greatest(0, least(s.size, cast(floor(t.target) as bigint) - t.source_size - s.start))
         + greatest(0, least(s.size, cast(floor(t.target) as bigint) - 2 * t.source_size - s.start)) as taken
  from started s join targets t on s.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, source_size, target, cast(taken as bigint) as taken,
       case when taken > 0 then round(case when tilt = 0 then start / target
         else ((tilt - 1) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * (start / target))) / (2 * tilt) end, 9) end as position
from took
"""
