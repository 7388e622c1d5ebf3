"""Near duplicates by word shingles: an LSH forest of MinHash signatures.

The similarity of two texts is the Jaccard index of their sets of shingles (runs of `words` words). Minima of
seeded hashes over a set make its pool; a tree reads DEEPEST of them, in a place of the pool of its own, as the
signature by which it sorts all sets. Texts that are neighbours in a sorted order and share a prefix of at
least DEPTH minima are candidates; a region is all that share such a prefix. Depth adapts to the region: one of
at most TINY members is compared in full; a crowded one is compared with one centre, and split by one more
minimum, until its parts are tiny or signatures end. The number of trees follows from the least similarity, so
that a pair at it shares no region with probability at most MISS.

Trees come in two rounds. The links that the first ones find are confirmed and joined to components at once; the others
look for pairs of different components only, and leave out regions whose members are all in one. A large group of near
copies is so compared with a few centres instead of one in every tree and at every depth.

What depth alone would lose in crowded regions is made good: members that the links found so far leave outside
the largest component of their region are compared with all others of it, in blocks of bounded size. Nothing is
capped. A link is confirmed on the whole sets; components are those of all links in regions.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.components import components
from trafficlens.llm.hot import join_counted
from trafficlens.llm.text import row_key, whole
from trafficlens.operators.skew import materialize, scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DEPTH, DEEPEST = 4, 8
MISS = 1e-6
# trees of the first round
FIRST_TREES = 2
# members of a region that are compared in full
TINY = 8
# parts of a crowded region's rows in joins
SALTS = 16
# shingles in a block of a crowded region, on average
BLOCK = 60_000
# distinct words that a task remembers, and shingles that are hashed at once
REMEMBERED, AT_ONCE = 100_000, 1024
FACTOR = np.uint64(0x9E3779B97F4A7C15)
WIDTH = 4


@dataclass(frozen=True)
class Likeness:
    """Words in a shingle, and the least similarity as a fraction, so that the test is exact."""

    words: int
    least: tuple[int, int]

    @property
    def trees(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - (self.least[0] / self.least[1]) ** DEPTH))

    def fits(self, a: Column, b: Column) -> Column:
        """Sizes of sets that can be similar at all."""
        return F.least(a, b) * self.least[1] >= F.greatest(a, b) * self.least[0]

    def enough(self, common, a, b):
        """The test itself, on the sizes of the common part and of both sets."""
        return common * (self.least[0] + self.least[1]) >= (a + b) * self.least[0]


class Words(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, size: int, known: Words) -> np.ndarray:
    """Distinct hashes of the runs of `size` words, ASCII lower case. Fewer words are one run; without words there is none."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.zeros(max(len(found), size), np.uint64)
    hashes[:len(found)] = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = len(hashes) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * FACTOR + hashes[k:k + n]
    return np.unique(mixed(total))


def _seeds(trees: int) -> tuple[np.ndarray, np.ndarray]:
    flip, odd = np.random.default_rng(12).integers(0, 1 << 32, (2, trees * DEPTH), np.uint64).astype(np.uint32)
    return flip, odd | np.uint32(1)


def pool(found: np.ndarray, seeds: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Minima of the set under every hash, each as WIDTH bytes that sort like it; the first ones follow the last again."""
    flip, odd = seeds
    low = found.astype(np.uint32)
    least = np.full(len(flip), (1 << 32) - 1, np.uint32)
    for start in range(0, len(low), AT_ONCE):
        hashed = low[start:start + AT_ONCE, None] ^ flip
        hashed *= odd
        np.minimum(least, hashed.min(axis=0), out=least)
    return np.append(least, least[:DEEPEST - DEPTH]).astype(">u4").tobytes()


def _sketches(words: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seeds = Words(), _seeds(trees)
        for batch in batches:
            sizes, pools = [], []
            for text in batch.column(4):
                found = shingles(text.as_py(), words, known)
                sizes.append(len(found))
                pools.append(pool(found, seeds) if len(found) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(pools, pa.binary())],
                                             ["doc_id", "_id", "_text", "node", "n", "pool"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for batch in batches:
            found = [shingles(t.as_py(), words, known).astype(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "runs"])
    return run


def based(docs: DataFrame) -> DataFrame:
    """doc_id, _id, _text, node, _data: equal texts are one node, the first half of their SHA-256."""
    text = whole("text")
    node = F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    return docs.select("doc_id", *row_key(F.col("doc_id"), text), node.alias("node"), text.cast("binary").alias("_data"))


def sketched(docs: DataFrame, like: Likeness) -> DataFrame:
    """doc_id, _id, _text, node, n, pool of every row, stored; without words n is 0 and the pool null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _id {kind}, _text bigint, node binary, n bigint, pool binary"
    return materialize(based(docs).mapInArrow(_sketches(like.words, like.trees), schema), "sketches")


def row_order() -> Column:
    """A row in the order in which rows of a component are kept: null ids last."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_text").alias("t"))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in sorted order, those that share DEPTH minima with the one before or after, and what the one before has in
    the columns from `node` on where they do.

    The ends of a partition have neighbours elsewhere: they stay.
    """
    # the last row so far waits for the one after it
    held, held_before, first = None, (None,), True
    for batch in batches:
        if not len(batch):
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        sig = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.uint32).reshape(len(rows), -1)
        tree = rows.column(0).to_numpy()
        linked = (sig[1:, :DEPTH] == sig[:-1, :DEPTH]).all(axis=1) & (tree[1:] == tree[:-1])
        told = rows.columns[2:]

        def before(k: int) -> tuple:
            return tuple(c[k - 1].as_py() if linked[k - 1] else None for c in told)

        keep = linked.copy()
        keep[1:] |= linked[:-1]
        if len(keep):
            keep[0] |= first or held_before[0] is not None
            at = np.flatnonzero(keep).tolist()
            yield _with_before(rows.take(pa.array(at, pa.int64())), [before(k) if k else held_before for k in at])
            held_before, first = before(len(rows) - 1), False
        held = rows.slice(len(rows) - 1)
    if held is not None:
        yield _with_before(held, [held_before])


def _with_before(rows: pa.RecordBatch, before: list[tuple]) -> pa.RecordBatch:
    names, told = rows.schema.names, rows.columns[2:]
    columns = [pa.array([b[k] if b[0] is not None else None for b in before], c.type) for k, c in enumerate(told)]
    return pa.RecordBatch.from_arrays([*rows.columns, *columns], [*names, "before", *[f"before_{n}" for n in names[3:]]])


def ordered_neighbours(nodes: DataFrame, like: Likeness, trees: range | None = None) -> DataFrame:
    """tree, sig, node, n, part, before, before_n, before_part of the sets that have a neighbour in some sorted order, stored.

    Orders are range-partitioned, the node last in the key, so that sets with one signature spread as well. `part` names the
    component that a set is known to be in, null (or no such column) if none is known.
    """
    trees = range(like.trees) if trees is None else trees
    sigs = F.array(*[F.substring("pool", 1 + t * DEPTH * WIDTH, DEEPEST * WIDTH) for t in trees])
    part = F.col("part") if "part" in nodes.columns else F.lit(None).cast("binary")
    rows = nodes.filter("n > 0").select(F.posexplode(sigs).alias("tree", "sig"), "node", "n", part.alias("part"))
    ordered = rows.withColumn("tree", F.col("tree") + trees.start).repartitionByRange("tree", "sig", "node").sortWithinPartitions("tree", "sig", "node")
    return materialize(ordered.mapInArrow(_neighbours, "tree int, sig binary, node binary, n bigint, part binary, before binary, before_n bigint, before_part binary"), "forest")


def _apart(a: str, b: str) -> Column:
    """Whether two sets are not known to be in one component."""
    return ~F.coalesce(F.col(a) == F.col(b), F.lit(False))


def _pairs(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _salt(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(SALTS)).cast("int")


def _salts() -> Column:
    return F.explode(F.array(*[F.lit(k) for k in range(SALTS)]))


def candidates(forest: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowded): candidate pairs (a, b) with a < b, and the members (key, node, n) of regions that are too
    large to be compared in full at DEPTH. Both leave out what is known to be in one component."""
    found = [forest.filter(F.col("before").isNotNull() & like.fits(F.col("n"), F.col("before_n")) & _apart("part", "before_part")).select(*_pairs("node", "before"))]
    rows, crowded = forest.select("tree", "sig", "node", "n", "part"), None
    for depth in range(DEPTH, DEEPEST + 1):
        level = rows.withColumn("key", F.xxhash64("tree", F.substring("sig", 1, depth * WIDTH)))
        # another centre in every tree, so that their stars overlap
        centre = F.min(F.struct(F.xxhash64("key", "node").alias("h"), F.col("node").alias("c"), F.col("n").alias("m"), F.col("part").alias("p")))
        size = F.count(F.lit(1))
        joined = (F.count("part") == size) & (F.min("part") == F.max("part"))
        large = level.groupBy("key").agg(size.alias("size"), centre.alias("_c"), joined.alias("joined")).filter(F.col("size") > TINY)
        spread = large.select("key", "_c.c", "_c.m", "_c.p", "joined", _salts().alias("salt"))
        level = level.withColumn("salt", _salt("node")).join(spread, ["key", "salt"], "left").drop("salt")
        level = materialize(level.filter("joined is null or not joined").drop("joined"), "level")
        tiny = level.filter("c is null").select("key", "node", "n", "part")
        other = tiny.select("key", F.col("node").alias("other"), F.col("n").alias("m"), F.col("part").alias("other_part"))
        met = (F.col("node") < F.col("other")) & like.fits(F.col("n"), F.col("m")) & _apart("part", "other_part")
        found.append(tiny.join(other, "key").filter(met).select(F.col("node").alias("a"), F.col("other").alias("b")))
        rest = level.filter("c is not null")
        found.append(rest.filter((F.col("node") != F.col("c")) & like.fits(F.col("n"), F.col("m")) & _apart("part", "p")).select(*_pairs("node", "c")))
        rows = rest.select("tree", "sig", "node", "n", "part")
        if crowded is None:
            crowded = rest.select("key", "node", "n")
        if not rows.limit(1).count():
            break
    return materialize(reduce(DataFrame.unionAll, found).distinct(), "pairs"), crowded


def confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    left, right = (sets.select(F.col("node").alias(x), F.col("runs").alias(f"_{x}")) for x in "ab")
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").filter(like.enough(common, F.size("_a"), F.size("_b"))).select("a", "b")


def block_links(left: list[np.ndarray], left_roots: list, right: list[np.ndarray], right_roots: list, like: Likeness) -> list[tuple[int, int]]:
    """(i, j) of similar sets of different components in two blocks; of several links from i to one component, one."""
    sizes = np.array([len(s) for s in left])
    values = np.concatenate(left) if left else np.zeros(0, np.int64)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], np.repeat(np.arange(len(left)), sizes)[order]
    found, linked = [], set()
    for j, (runs, root) in enumerate(zip(right, right_roots)):
        low, high = np.searchsorted(values, runs, "left"), np.searchsorted(values, runs, "right")
        hits = high - low
        at = np.repeat(low - np.append(0, np.cumsum(hits)[:-1]), hits) + np.arange(hits.sum())
        common = np.bincount(owners[at], minlength=len(left))
        for i in np.flatnonzero(like.enough(common, sizes, len(runs))).tolist():
            if left_roots[i] != root and (i, root) not in linked:
                linked.add((i, root))
                found.append((i, j))
    return found


def _blocks(like: Likeness) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def compare(outside: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        found = block_links(outside["runs"].tolist(), outside["root"].tolist(), members["runs"].tolist(), members["root"].tolist(), like)
        a, b = outside["root"].tolist(), members["root"].tolist()
        return pd.DataFrame({"a": [a[i] for i, _ in found], "b": [b[j] for _, j in found]}, columns=["a", "b"])
    return compare


def outside_links(crowded: DataFrame, roots: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between components, from members outside the largest component of a crowded region to all its members.

    Both sides are cut into blocks of about BLOCK shingles; a task has one block of each at a time.
    """
    named = roots.select("node", F.col("root").alias("_root"))
    placed = materialize(crowded.join(named, "node", "left").select("key", "node", "n", F.coalesce("_root", "node").alias("root")), "placed")
    shares = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words"))
    regions = (shares.groupBy("key").agg(F.max(F.struct("rows", "root", "words")).alias("_top"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("parts"))
               .filter("parts > 1").select("key", F.col("_top.root").alias("top"), F.ceil(F.col("words") / BLOCK).alias("blocks"),
                                           F.ceil((F.col("words") - F.col("_top.words")) / BLOCK).alias("outer")))
    regions = regions.select("*", _salts().alias("salt"))
    members = materialize(placed.withColumn("salt", _salt("node")).join(regions, ["key", "salt"]).join(sets, "node")
                          .select("key", "root", "runs", "top", "blocks", "outer", F.xxhash64("node", "key").alias("_h")), "regions")
    inner, outer = F.pmod("_h", "blocks"), F.pmod(F.shiftright("_h", 20), "outer")
    all_of = members.select("key", "root", "runs", inner.alias("block"), F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("part"))
    outside = (members.filter("root <> top")
               .select("key", "root", "runs", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), outer.alias("part")))
    keys = ["key", "block", "part"]
    met = outside.groupBy(*keys).cogroup(all_of.groupBy(*keys)).applyInPandas(_blocks(like), "a binary, b binary")
    return met.select(*_pairs("a", "b")).distinct()


@dataclass(frozen=True)
class Classes:
    """rows: doc_id, _id, _text, node, n of every row. nodes: node, first (its row that comes first), copies, n, root (of its component)."""

    rows: DataFrame
    nodes: DataFrame


def classes(docs: DataFrame, like: Likeness, proposed: Callable[[DataFrame], DataFrame] | None = None) -> Classes:
    """Components of all links. `proposed` may give further candidate pairs (a, b) of nodes, which are confirmed in the first round."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(sketched(docs, like))
        nodes = materialize(rows.groupBy("node").agg(F.min(row_order()).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("pool").alias("pool")), "nodes")
        return Classes(rows.drop("pool"), keep(_classified(docs, nodes, like, proposed(docs) if proposed else None)))


def _sets_of(docs: DataFrame, nodes: DataFrame, asked: DataFrame, like: Likeness) -> DataFrame:
    """node, runs of the nodes asked for, stored: one row of every text that is to be compared; the others never move."""
    firsts = nodes.join(asked, "node", "left_semi").select("first.i", "first.t", "node").withColumnsRenamed({"i": "_id", "t": "_text"})
    texts = based(docs).select("_id", "_text", "_data").join(firsts, ["_id", "_text"]).select("node", "_data")
    return materialize(texts.mapInArrow(_sets(like.words), "node binary, runs array<bigint>").dropDuplicates(["node"]), "sets")


def _asked(pairs: DataFrame, crowded: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(crowded.select("node")).distinct()


def _classified(docs: DataFrame, nodes: DataFrame, like: Likeness, proposed: DataFrame | None) -> DataFrame:
    pairs, crowded = candidates(ordered_neighbours(nodes, like, range(FIRST_TREES)), like)
    if proposed is not None:
        pairs = materialize(pairs.unionAll(proposed.select(*_pairs("a", "b"))).distinct(), "pairs")
    sets = _sets_of(docs, nodes, _asked(pairs, crowded), like)
    roots = components(confirmed(pairs, sets, like))
    # the other trees look for what is not joined yet
    roots = materialize(roots, "parts")
    parted = nodes.join(roots.withColumnRenamed("root", "part"), "node", "left")
    pairs, more_crowded = candidates(ordered_neighbours(parted, like, range(FIRST_TREES, like.trees)), like)
    asked = _asked(pairs, more_crowded).join(sets, "node", "left_anti")
    sets = sets.unionAll(_sets_of(docs, nodes, asked, like))
    crowded = crowded.unionAll(more_crowded)
    # a node and the root of its part stand for the links of the first round
    known = roots.select(*_pairs("node", "root"))
    roots = components(known.unionAll(confirmed(pairs, sets, like)))
    more = components(outside_links(crowded, roots, sets, like))
    above = more.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    named = nodes.drop("pool").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(above, "root", "left").select("node", "first", "copies", "n", F.coalesce("_top", "root").alias("root"))
    return materialize(named, "classes")


def near_duplicates(docs: DataFrame, words: int = 3, least: tuple[int, int] = (17, 20)) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Texts without words, null texts among them, have no shingles and are linked with nothing. Documents with null ids get
    the smallest id of their component like the rest, null if there is none, and are then kept. Rows that repeat come out as
    often. Texts count whole, however long; an empty table gives an empty table. Other columns are ignored.
    """
    found = classes(docs, Likeness(words, least))
    firsts = found.nodes.filter("n > 0").select("root", F.when(~F.col("first.n"), F.col("first.i")).alias("i")).groupBy("root").agg(F.min("i").alias("_least"))
    # components may hold very many nodes: most are single, and those need no join
    named = found.nodes.select("node", "copies", "root").join(firsts, "root").select("node", "copies", "_least")
    rows = found.rows.select("doc_id", "node", "n")
    linked = join_counted(rows.filter("n > 0"), materialize(named, "named"), "node", "copies").select("doc_id", "n", F.col("_least").alias("component_id"))
    every = linked.unionAll(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return every.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
