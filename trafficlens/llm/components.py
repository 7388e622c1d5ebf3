"""Connected components by contraction.

Every node hooks onto the neighbour that comes first in a random order of the round; edges are then
drawn between the nodes hooked onto, until none is left. The order is drawn anew in every round, so
chains stay short whatever the ids. Grouping by node is combined before the shuffle, so a node with
very many edges sends few rows; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.skew import materialize


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); nodes share a root if and only if they are connected."""
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds = []
    while edges.limit(1).count():
        rank = F.xxhash64(F.lit(len(rounds)), "b")
        both = edges.select("a", "b").unionAll(edges.select("b", "a"))
        firsts = both.groupBy("a").agg(F.min(F.struct(rank.alias("r"), F.col("b").alias("n"))).alias("_first"))
        own = F.struct(F.xxhash64(F.lit(len(rounds)), "a").alias("r"), F.col("a").alias("n"))
        hooked = materialize(firsts.select(F.col("a").alias("node"), F.least("_first", own)["n"].alias("root")), "hooked")
        rounds.append(hooked)
        by_a = hooked.withColumnsRenamed({"node": "a", "root": "_a"})
        by_b = hooked.withColumnsRenamed({"node": "b", "root": "_b"})
        moved = edges.join(by_a, "a").join(by_b, "b").filter("_a <> _b")
        edges = materialize(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[-1]
    for hooked in reversed(rounds[:-1]):
        above = found.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        found = hooked.join(above, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))
    return found
