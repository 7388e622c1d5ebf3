"""SimHash fingerprints of 64 bits, and search by permuted block tables.

Every occurrence of a term votes with its weight on each bit of its hash; a bit of the fingerprint
is 1 where the ones have more than half of the weight. Two bit positions share one long while the
votes are summed, so a text costs 32 sums inside one hash aggregation, with a partial aggregate
before the shuffle: one narrow row per text and task is moved, never a term.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.text import ascii_lower, repeated, row_key, whole, words
from trafficlens.operators.skew import CHUNK, materialize

BITS = 64
LANES = (1 << 32) | 1


def shingled(df: DataFrame, text: Column, size: int, keep: Sequence[str]) -> DataFrame:
    """One row per run of `size` words, repeats included: keep..., term, first.

    Fewer words give the whole sequence; a text without words gives one row with a null term.
    `first` marks one row of every text.
    """
    listed = df.select(*keep, words(ascii_lower(text)).alias("_w"))
    shifted = [F.slice("_w", k + 1, F.greatest(F.size("_w"), F.lit(1))).alias(f"w{k}") for k in range(size)]
    rows = listed.select(*keep, F.size("_w").alias("_n"), F.posexplode_outer(F.arrays_zip(*shifted)).alias("_p", "_z"))
    parts = [F.col(f"_z.w{k}") for k in range(size)]
    last = F.least(F.lit(size), F.col("_n"))
    whole_run = F.coalesce(F.col("_p") + last <= F.col("_n"), F.lit(True))
    return (rows.filter(whole_run)
            .select(*keep, F.when(F.col("_n") > 0, F.concat_ws(" ", *parts)).alias("term"),
                    F.coalesce(F.col("_p") == 0, F.lit(True)).alias("first")))


def fingerprints(terms: DataFrame, keys: Sequence[str], weight: Column | None = None) -> DataFrame:
    """keys..., copies, fingerprint (bigint) from rows (keys..., term, first).

    Rows that repeat a key scale all its votes alike, so they change no bit; `copies` counts them.
    A text without terms has fingerprint 0.
    """
    hashed = terms.select(*keys, "first", F.when(F.col("term").isNotNull(), F.xxhash64("term")).alias("_h"),
                          (F.lit(1) if weight is None else weight).cast("bigint").alias("_weight"))
    votes = [F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(LANES)) * F.col("_weight")).alias(f"_v{k}")
             for k in range(BITS // 2)]
    total = F.sum(F.when(F.col("_h").isNotNull(), F.col("_weight"))).alias("_total")
    summed = terms_sum(hashed, keys, [F.count_if("first").alias("copies"), total, *votes])

    def bit(ones: Column, place: int) -> Column:
        value = (1 << place) - (1 << 64 if place == 63 else 0)
        return F.when(ones * 2 > F.col("_total"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    low = [bit(F.col(f"_v{k}").bitwiseAND(F.lit((1 << 32) - 1)), k) for k in range(BITS // 2)]
    high = [bit(F.shiftrightunsigned(f"_v{k}", 32), k + 32) for k in range(BITS // 2)]
    return summed.select(*keys, "copies", reduce(lambda a, b: a.bitwiseOR(b), low + high).alias("fingerprint"))


def terms_sum(hashed: DataFrame, keys: Sequence[str], sums: Sequence[Column]) -> DataFrame:
    return hashed.groupBy(*keys).agg(*sums)


def as_hex(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - differing(a, b) / F.lit(float(BITS))


# --- permuted block tables ------------------------------------------------------------------------

def _block_masks(blocks: int) -> list[int]:
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def table_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Bits that a table compares exactly: all but `radius` of the blocks. Fingerprints within the
    radius differ in at most `radius` blocks, so they agree in all bits of at least one table."""
    masks = _block_masks(blocks or 2 * max(radius, 1))
    kept = len(masks) - radius
    return [sum(chosen) for chosen in combinations(masks, kept)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near(queries: DataFrame, index: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(query, found, distance): every fingerprint of the index within the radius of a query.

    Both frames have one column `fingerprint`, distinct. The index is laid out once per table, keyed
    by the table's bits; a pair that meets in several tables is given by the first of them only.
    """
    masks = [_signed(m) for m in table_masks(radius, blocks)]

    def laid_out(df: DataFrame, name: str) -> DataFrame:
        tables = F.array(*[F.struct(F.lit(k).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("bits"))
                           for k, m in enumerate(masks)])
        return df.select(F.col("fingerprint").alias(name), F.explode(tables).alias("_t")).select(name, "_t.*")

    apart = F.col("query").bitwiseXOR(F.col("found"))
    earlier = [(F.col("table") > k) & (apart.bitwiseAND(F.lit(m)) == 0) for k, m in enumerate(masks[:-1])]
    first = ~reduce(lambda a, b: a | b, earlier, F.lit(False))
    left, right = laid_out(queries, "query"), laid_out(index, "found").withColumnsRenamed({"table": "_table", "bits": "_bits"})
    met = (F.col("table") == F.col("_table")) & (F.col("bits") == F.col("_bits"))
    return (left.join(right, met & (F.bit_count(apart) <= radius) & first)
            .select("query", "found", F.bit_count(apart).alias("distance")))


# --- fingerprints of documents and of their edited texts --------------------------------------------

def following(df: DataFrame, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Adds next_<column>: the values of the next row in a global order; the first row follows the last.

    Rows are range-partitioned; only the first row of every partition is looked at across partitions.
    """
    chunked = materialize(df.repartitionByRange(*order).withColumn(CHUNK, F.spark_partition_id()), "following")
    inside = Window.partitionBy(CHUNK).orderBy(*order)
    values = F.struct(*columns)
    led = chunked.withColumn("_next", F.lead(values).over(inside))
    heads = (chunked.withColumn("_r", F.row_number().over(inside)).filter("_r = 1")
             .select(CHUNK, values.alias("_head")))
    by_chunk = Window.orderBy(CHUNK)
    everything = by_chunk.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(CHUNK, F.coalesce(F.lead("_head").over(by_chunk), F.first("_head").over(everything)).alias("_head"))
    # one row per partition
    joined = led.join(F.broadcast(heads), CHUNK).withColumn("_next", F.coalesce("_next", "_head"))
    return joined.select(*df.columns, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def document_prints(df: DataFrame, keep: Sequence[str], text: Column) -> DataFrame:
    """Fingerprint over word pairs, each weighing as many votes as it has characters."""
    return fingerprints(shingled(df, text, 2, keep), keep, F.char_length("term"))


def edited_fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how near they are.

    The edited text has its last third replaced by the start of the next document's, in descending
    order of doc_id (then of a hash of the text; null ids last), the first following the last. Rows
    that repeat (doc_id, text) hold one place in that order and get equal results. Null texts count
    as empty, with fingerprint 0. Other columns are ignored.

    `n_near`: for rows with doc_id divisible by `every`, the number of rows whose fingerprint is
    within `radius` bits, found with the block tables over all fingerprints; null for other rows.
    """
    base = docs.select("doc_id", whole("text").alias("text"))
    base = base.select("doc_id", "text", *row_key(F.col("doc_id"), F.col("text")))
    key = ["_id", "_text"]
    sized = base.withColumn("n_chars", F.char_length("text").cast("bigint"))
    prints = materialize(document_prints(sized, ["doc_id", *key, "n_chars"], F.col("text")), "prints")

    order = [F.desc_nulls_last("doc_id"), F.col("_text")]
    linked = (following(prints, order, ["_id", "_text", "fingerprint"])
              .withColumn("_take", F.floor(F.col("n_chars") / 3).cast("int")))
    linked = materialize(linked, "linked")
    wanted = linked.select(F.col("next__id").alias("_id"), F.col("next__text").alias("_text"),
                           F.col("_id").alias("_to_id"), F.col("_text").alias("_to_text"), "_take")
    # texts move once by their key; the pieces for the neighbours, a third at most, move once more
    pieces = (base.select(*key, "text").join(wanted, key)
              .select(F.col("_to_id").alias("_id"), F.col("_to_text").alias("_text"),
                      F.expr("substring(text, 1, _take)").alias("_piece"))
              .groupBy(*key).agg(F.max("_piece").alias("_piece")))
    carried = linked.select("doc_id", *key, "n_chars", "fingerprint", "next_fingerprint", "_take")
    edited = (base.select(*key, "text").join(carried, key).join(pieces, key)
              .withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars as int) - _take), _piece)"))
              .withColumn("edited_sha256", F.sha2("edited", 256))
              .withColumn("_own", F.col("fingerprint")))
    keep = ["doc_id", *key, "n_chars", "edited_sha256", "_own", "next_fingerprint"]
    found = document_prints(edited, keep, F.col("edited"))

    counted = prints.groupBy("fingerprint").agg(F.sum("copies").alias("rows"))
    queries = prints.filter(F.col("doc_id") % every == 0).select("fingerprint").distinct()
    close = (near(queries, counted.select("fingerprint"), radius)
             .join(counted.withColumnRenamed("fingerprint", "found"), "found")
             .groupBy("query").agg(F.sum("rows").alias("n_near")))
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    # rows that ask nothing keep a key of their own, so that they do not meet in one task
    found = (found.withColumn("_asked", asked)
             .withColumn("query", F.when(asked, F.col("_own")).otherwise(F.xxhash64(*key))))
    result = found.join(close.withColumn("_asked", F.lit(True)), ["_asked", "query"], "left")
    return repeated(result.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("_own")).alias("fingerprint"),
        as_hex(F.col("fingerprint")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("fingerprint")).alias("near_edited"),
        likeness(F.col("_own"), F.col("next_fingerprint")).alias("near_next"),
        F.col("n_near").cast("bigint").alias("n_near"), "copies"), "copies")
