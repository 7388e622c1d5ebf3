"""Near copies by five-word similarity: the pipeline's stage.

SimHash first, as in `neardup.py`: fingerprints of five-word runs that are within RADIUS bits are found over their anchors,
and every such pair of texts is confirmed on the whole sets of runs, a Jaccard index of 0.8 or more. Pairs
at that index differ in 2 to 13 bits, beyond any radius that anchors reach; what the fingerprints have not joined is
therefore looked for by the forest of `forest.py`, which takes their components as given. Links are closed
transitively, and of each component one document stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trafficlens.llm.forest import Likeness, based, classes
from trafficlens.llm.neardup import linked
from trafficlens.llm.simhash import fingerprints, shingled
from trafficlens.llm.text import row_key, whole
from trafficlens.operators.skew import materialize, scratch

WORDS = 5
LEAST = (4, 5)
# bits that differ in fingerprints whose texts are compared
RADIUS = 2


def fingerprint_pairs(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Candidate pairs (a, b) of nodes by SimHash, stored: every text with one of its fingerprint, and one text each of
    fingerprints that are linked. Texts without words are in none."""
    base = based(docs).select("node", F.col("_data").cast("string").alias("text"))
    terms = shingled(base, F.col("text"), words, ["node"]).filter("term is not null")
    prints = materialize(fingerprints(terms, ["node"]).select("node", "fingerprint"), "prints")
    centres = materialize(prints.groupBy("fingerprint").agg(F.min("node").alias("centre")), "centres")
    same = prints.join(centres, "fingerprint").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    left, right = (centres.select(F.col("fingerprint").alias(f), F.col("centre").alias(c)) for f, c in (("a", "_a"), ("b", "_b")))
    near = linked(centres.select("fingerprint"), radius).join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return materialize(same.unionAll(near), "near")


def keep_one(docs: DataFrame, words: int = WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The document with the smallest id of every component of links, with all its columns (null ids come last).

    Null texts count as empty; texts without words are alike. Of rows that repeat id and text one stays. Texts count
    whole, however long; an empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as keep:
        found = classes(docs, Likeness(words, least), lambda d: fingerprint_pairs(d, words))
        # texts without words have no runs: one component of their own
        roots = found.nodes.withColumn("root", F.when(F.col("n") > 0, F.col("root")).otherwise(F.lit(b"")))
        firsts = roots.groupBy("root").agg(F.min("first").alias("_k")).select(F.col("_k.i").alias("_id"), F.col("_k.t").alias("_text"))
        kept = keep(materialize(firsts, "kept"))
    # whole rows travel as one column, so that no name of theirs clashes
    rows = docs.select(F.struct("*").alias("_row"), *row_key(F.col("doc_id"), whole("text"))).join(kept, ["_id", "_text"], "left_semi")
    same = Window.partitionBy("_id", "_text").orderBy("_id")
    return rows.withColumn("_r", F.row_number().over(same)).filter("_r = 1").select("_row.*")
