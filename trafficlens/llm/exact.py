"""Exact duplicates with the frequent digests taken out first.

A Misra-Gries sketch (merged in two levels) names digests that may be frequent. Their rows are
counted exactly, and the verified winners, at most `top` rows, are broadcast: their groups are
settled on the map side, whatever their size. All other digests are shuffled; their groups are
small because the sketch bounds what it can miss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.text import whole
from trafficlens.operators.skew import materialize

TRACKED = 2048
TOP = 256
MERGERS = 32


def digest(text: Column | str) -> Column:
    return F.sha2(whole(text), 256)


def frequent(digests: DataFrame, tracked: int = TRACKED, top: int = TOP) -> DataFrame:
    """At most `top` digests that may be frequent; every digest above about 7 / tracked of the rows is among them."""
    top = min(top, tracked)
    local = (digests.groupBy((F.spark_partition_id() % MERGERS).alias("_m"))
             .agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("_s")))
    # a grouping key, though constant: without one, empty partitions send sketches that cannot be merged
    merged = local.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(_s, {tracked}), {top})").alias("_top"))
    return merged.select(F.explode("_top").alias("_t")).select(F.col("_t.item").alias("digest"))


def winners(rows: DataFrame, tracked: int = TRACKED, top: int = TOP) -> DataFrame:
    """digest, keep_id, group_size of verified frequent digests: at most `top` rows."""
    named = F.broadcast(frequent(rows.select("digest"), tracked, top))
    return (rows.join(named, "digest", "left_semi").groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
            .filter("group_size > 1"))


def exact_duplicates(docs: DataFrame, tracked: int = TRACKED, top: int = TOP) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays (null ids are smallest); of rows that repeat
    that id, one stays. Null texts equal the empty text. Other columns are ignored.
    """
    rows = materialize(docs.select("doc_id", digest("text").alias("digest")), "digests")
    found = F.broadcast(materialize(winners(rows, tracked, top), "winners"))
    marked = rows.join(found, "digest", "left")
    is_winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    light = marked.filter("group_size is null").select("doc_id", "digest")
    settled = (marked.filter(F.col("group_size").isNotNull() & ~is_winner)
               .select("doc_id", "keep_id", "group_size", F.lit(False).alias("kept"), "digest"))
    # rows of the winning id: one as a rule, one stays if the id repeats
    first = (marked.filter(F.col("group_size").isNotNull() & is_winner)
             .groupBy("doc_id", "keep_id", "group_size", "digest").agg(F.count(F.lit(1)).cast("int").alias("_rows"))
             .select("doc_id", "keep_id", "group_size", F.posexplode(F.array_repeat(F.lit(0), F.col("_rows"))).alias("_p", "_z"), "digest")
             .select("doc_id", "keep_id", "group_size", (F.col("_p") == 0).alias("kept"), "digest"))
    alike = Window.partitionBy("digest")
    rest = light.select("doc_id", F.max("doc_id").over(alike).alias("keep_id"), F.count(F.lit(1)).over(alike).alias("group_size"),
                        (F.row_number().over(alike.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"), "digest")
    return rest.unionByName(settled).unionByName(first).withColumnRenamed("digest", "text_sha256")


def keep_one(docs: DataFrame, tracked: int = TRACKED, top: int = TOP) -> DataFrame:
    """The rows that stay, with all their columns. Copies of frequent texts are dropped before the shuffle."""
    # whole rows travel as one column, so that no name of theirs clashes
    marked = docs.select(F.struct("*").alias("_row"), "doc_id", digest("text").alias("_digest"))
    small = materialize(docs.select("doc_id", digest("text").alias("digest")), "digests")
    found = F.broadcast(materialize(winners(small, tracked, top), "winners")
                        .select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.lit(True).alias("_heavy")))
    left = marked.join(found, "_digest", "left").filter(F.col("_heavy").isNull() | F.col("doc_id").eqNullSafe(F.col("_keep")))
    newest = Window.partitionBy("_digest").orderBy(F.desc_nulls_last("doc_id"))
    return left.withColumn("_r", F.row_number().over(newest)).filter("_r = 1").select("_row.*")


EXACT_SQL = """
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents)
"""
