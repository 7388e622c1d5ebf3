"""The LSH forest against a loop over all pairs."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import forest

LIKE = forest.Likeness(3, (17, 20))


def shingles(text, size=3):
    found = (text or "").encode().lower().split()
    return {tuple(found[k:k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def expected(rows, least=(85, 100), size=3):
    """doc_id, set size, smallest id reachable, whether it is the own id."""
    sets, root = [shingles(t, size) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    owners = {}
    for i, s in enumerate(sets):
        for g in s:
            owners.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        common = {}
        for g in s:
            for j in owners[g]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, c in common.items():
            if least[1] * c >= least[0] * (len(s) + len(sets[j]) - c):
                root[top(i)] = top(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[top(i)] = min(doc_id, smallest.get(top(i), doc_id))
    return [(rows[i][0], len(sets[i]), smallest.get(top(i)), rows[i][0] == smallest.get(top(i))) for i in range(len(rows))]


def key(row):
    return tuple((v is None, v) for v in row)


def compare(spark, docs):
    want = expected([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    got = forest.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(key(r) for r in got.collect()) == sorted(map(key, want))
    return want


def edited(draw, words, edits):
    words = list(words)
    for p in draw.sample(range(len(words)), edits):
        words[p] = f"n{draw.randrange(10 ** 9)}"
    return " ".join(words)


def test_odd_rows_and_small_documents(spark, odd, small):
    compare(spark, odd)
    compare(spark, small)
    assert forest.near_duplicates(odd.limit(0)).collect() == []


def test_one_large_group_of_copies_and_borderline_texts(spark, monkeypatch):
    """Regions far beyond TINY: copies of one text at 0.95 to 0.6, of which many are linked with few others or none."""
    monkeypatch.setattr(forest, "BLOCK", 3_000)
    draw = random.Random(2)
    base = [f"t{draw.randrange(4000)}" for _ in range(150)]
    rows = [(i, edited(draw, base, draw.choice([1, 2, 3, 4, 5, 6, 8, 10]))) for i in range(300)]
    # copies of copies, without the base: chains
    rows += [(400 + i, edited(draw, rows[i][1].split(), 3)) for i in range(0, 300, 5)]
    rows += [(600, rows[7][1].upper()), (601, rows[7][1]), (602, rows[7][1].replace(" ", "\t ")), (603, "a b"), (604, "A  b"), (605, "a b c"), (606, None), (607, " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    want = compare(spark, docs)
    sizes = {}
    for _, _, c, _ in want:
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) > 100 and sum(v == 1 for v in sizes.values()) > 30


def test_links_outside_the_largest_component_are_found_in_blocks(spark):
    """No stars, no pairs: everything is left to the blocks."""
    draw = random.Random(4)
    base = [f"t{k}" for k in range(80)]
    texts = [edited(draw, base, draw.choice([1, 2, 4, 6])).encode() for _ in range(60)]
    known = forest.Words()
    sets = [forest.shingles(t, 3, known).astype(np.int64) for t in texts]
    roots = [k // 3 for k in range(60)]
    found = forest.block_links(sets[:25], roots[:25], sets, roots, LIKE)
    linked = {(i, roots[j]) for i in range(25) for j in range(60) if roots[i] != roots[j]
              and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))}
    assert linked and {(i, roots[j]) for i, j in found} == linked and len(found) == len(linked)


def test_half_a_region_unlike_its_centre_stays_linear(spark):
    """2,000 members, half of them far from the other half: rows of candidates stay below 10 for each member of a tree."""
    draw = random.Random(9)
    halves = [[f"{h}{k}" for k in range(60)] for h in "ab"]
    texts = [edited(draw, halves[k % 2], 1) for k in range(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = forest.sketched(docs, LIKE)
    nodes = rows.groupBy("node").agg(F.first("n").alias("n"), F.first("pool").alias("pool"))
    near = forest.ordered_neighbours(nodes, LIKE)
    pairs, crowded = forest.candidates(near, LIKE)
    assert pairs.count() < 10 * near.count() and crowded.count() <= near.count()
    assert forest.near_duplicates(docs).filter("kept").count() == 2


@pytest.mark.parametrize("least", [(17, 20), (4, 5)])
def test_sets_at_the_least_similarity_meet(least):
    like, draw = forest.Likeness(3, least), np.random.default_rng(1)
    seeds, agreed, met = forest._seeds(like.trees), 0, 0
    for _ in range(300):
        common = 40 * least[0]
        alone = (40 * least[1] - common) // 2
        every = draw.integers(0, 1 << 63, common + 2 * alone, np.uint64)
        pools = [np.frombuffer(forest.pool(np.unique(s), seeds), ">u4")[:like.trees * forest.DEPTH] for s in (every[:common + alone], np.append(every[:common], every[common + alone:]))]
        same = (pools[0] == pools[1])
        agreed += same.mean()
        met += same.reshape(-1, forest.DEPTH).all(axis=1).any()
    assert met >= 299 and abs(agreed / 300 - least[0] / least[1]) < 0.01


def test_neighbours_over_batches(spark):
    """Rows of one partition in any batch sizes give the same neighbours."""
    import pyarrow as pa
    draw = np.random.default_rng(0)
    sig = np.sort(draw.integers(0, 3, (200, 8)).astype(">u4").view("S32").ravel())
    rows = pa.RecordBatch.from_arrays([pa.array([0] * 200, pa.int32()), pa.array([bytes(s).ljust(32, b"\0") for s in sig], pa.binary()),
                                       pa.array([str(k).encode() for k in range(200)], pa.binary()), pa.array(range(200), pa.int64())], ["tree", "sig", "node", "n"])
    whole = None
    for size in (200, 1, 7, 64):
        found = pd.concat([b.to_pandas() for b in forest._neighbours(iter([rows.slice(k, size) for k in range(0, 200, size)]))]).sort_values("n").reset_index(drop=True)
        assert whole is None or whole.equals(found)
        whole = found
    linked = {k: rows.column(1)[k].as_py()[:16] == rows.column(1)[k - 1].as_py()[:16] for k in range(1, 200)}
    assert {r.n for r in whole.itertuples() if r.before is not None} == {k for k, v in linked.items() if v}
