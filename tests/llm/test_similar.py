"""The pipeline's near-dedup stage against a loop over all pairs."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from trafficlens.llm import similar


def shingles(text):
    found = (text or "").encode().lower().split()
    return {tuple(found[k:k + 5]) for k in range(max(1, len(found) - 4))}


def kept(rows):
    """Smallest id of every component of pairs at 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common * 5 >= 4 * (len(sets[i]) + len(sets[j]) - common):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sorted(min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root))


def edited(draw, words, places):
    words = list(words)
    for p in places:
        words[p] = f"n{draw.randrange(10 ** 9)}"
    return words


def test_stage_drops_edited_copies_and_nothing_else(spark):
    draw = random.Random(5)
    rows, near = [], 0
    for g in range(60):
        base = [f"t{draw.randrange(3000)}" for _ in range(300)]
        # 1 to 6 single words 5 apart or more: similarity 0.97 down to 0.82; 8 to 14: below 0.8
        for edits in (0, 1, 3, 5, 6, 8, 14):
            rows.append((len(rows) * 7 % 1000, " ".join(edited(draw, base, draw.sample(range(10, 290, 10), edits)))))
    chain = [f"c{k}" for k in range(300)]
    for k in range(20):
        # each is near the one before it only
        rows.append((2000 + k, " ".join(chain)))
        chain = edited(draw, chain, range(12 * k + 10, 12 * k + 40, 6)) if k < 19 else chain
    rows += [(3000, "One two"), (3001, "one  TWO"), (3002, "one two three"), (3003, ""), (3004, " \n")]
    want = kept(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, source string").repartition(4)
    found = dict(corpus_pipeline.STAGES[2:3])[corpus_pipeline.STAGES[2][0]](spark, docs, "")
    assert found.columns == docs.columns and sorted(r["doc_id"] for r in found.collect()) == want
    assert len(want) < len(rows) - 200


def test_null_ids_repeated_rows_and_clashing_names(spark, odd):
    found = similar.keep_one(odd)
    assert found.columns == odd.columns
    # rows 8, 9, 10 are alike; 5 and 4 stand alone; 6, 100 are equal, 7 has the same words
    assert sorted(r["doc_id"] for r in found.collect() if r["doc_id"] is not None) == [-5, 1, 4, 5, 6, 8, 50]
    assert similar.keep_one(odd.limit(0)).count() == 0


def test_fingerprints_join_copies_and_the_forest_leaves_joined_texts_alone(spark):
    from trafficlens.llm import forest
    draw = random.Random(8)
    base = [f"t{draw.randrange(3000)}" for _ in range(300)]
    rows = [(k, " ".join(edited(draw, base, draw.sample(range(10, 290, 10), 1)))) for k in range(60)]
    # the same runs in another form: one fingerprint
    rows += [(1000 + k, rows[k][1].upper()) for k in range(20)] + [(2000, None), (2001, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert similar.fingerprint_pairs(docs).count() >= 20
    like = forest.Likeness(similar.WORDS, similar.LEAST)
    sketches = forest.sketched(docs, like).groupBy("node").agg(F.max("n").alias("n"), F.max("pool").alias("pool"))
    counts = []
    for nodes in (sketches, sketches.selectExpr("*", "unhex('01') as part")):
        pairs, crowded = forest.candidates(forest.ordered_neighbours(nodes, like, range(2)), like)
        counts.append((pairs.count(), crowded.count()))
    # all in one component: nothing is left to compare
    assert counts[1] == (0, 0) and counts[0][0] > 60
