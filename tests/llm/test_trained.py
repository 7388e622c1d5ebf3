"""Trained operators: held-out accuracy, honest probabilities, cases at the edge."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import calibration, language, lm, quality, toxicity

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, None, None), (5, 0, 1), (6, 1, 0), (None, 1, 1), (8, 1, 0), (99, 0, 0)], LABELS)


def area(rows, label):
    """Share of pairs (label 1, label 0) in order, ties by half."""
    one, none = (np.array([r["score"] for r in rows if r[label] == k]) for k in (1, 0))
    return ((one[:, None] > none).mean() + (one[:, None] == none).mean() / 2)


def test_quality_of_held_out_documents(tables):
    docs, labels = tables
    scored = quality.quality(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and area(rows, "quality") > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_of_held_out_documents(tables):
    docs, labels = tables
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 60 and area(rows, "toxic") > 0.75
    again = {(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs.repartition(7), labels.repartition(3)).collect()}
    assert {(r["doc_id"], r["score"]) for r in rows} <= again
    clean = toxicity.keep_clean(docs, labels)
    bad = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - bad


@pytest.fixture(scope="module")
def dictionaries():
    rng = random.Random(5)
    clean = ["".join(rng.choice("aeiou") + rng.choice("bdklmnrst") for _ in range(rng.randrange(1, 4))) for _ in range(3_000)]
    bad = ["wuffig", "zwickel", "quarzig", "flopsig"]
    ordinary = [" ".join(rng.choices(clean, k=120)) for _ in range(400)]
    toxic = [" ".join(rng.choices(clean, k=50) + rng.choices(bad, k=4) + rng.choices(clean, k=50)) for _ in range(200)]
    return toxicity.train_dictionaries(ordinary, toxic), clean, bad


def test_passage_in_texts_of_any_length(dictionaries):
    """A toxic passage is far above clean text whether it stands alone or in 100,000 clean words, and a repeated line adds nothing."""
    contents, clean, bad = dictionaries
    windows = toxicity.Windows(*contents)
    rng = random.Random(6)
    passage = bad + rng.choices(clean, k=20)
    for size in (0, 100, 1_000, 10_000, 100_000):
        words = rng.choices(clean, k=size)
        with_it = words[:size // 2] + passage + words[size // 2:]
        assert windows.evidence(" ".join(with_it)) > windows.evidence(" ".join(words)) + 0.3, size
    once = windows.evidence(" ".join(bad[:1] + clean[:70]))
    assert windows.evidence(" ".join((bad[:1] + clean[:70]) * 30)) <= once


def test_evidence_equals_a_loop_over_all_runs(dictionaries):
    contents, clean, bad = dictionaries
    windows = toxicity.Windows(*contents)
    rng = random.Random(7)
    for size in (0, 1, 63, 64, 65, 300, 1_100):
        words = [w.encode() for w in rng.choices(clean + 200 * bad, k=size)]
        best, run = 0.0, 64
        runs = [len(words)]
        while run < len(words):
            runs.append(run)
            run *= 4
        for run in runs:
            for start in range(len(words) - run + 1):
                saved = sum(windows.saved(w) for w in {*words[start:start + run]})
                best = max(best, saved / math.sqrt(run + 50))
        best -= 0.02 * math.log2(max(1.0, len(words) / 64))
        assert windows.evidence(b" ".join(words).decode()) == round(32 * max(0.0, best)) / 32


def test_toxicity_when_all_labelled_texts_are_long(spark, dictionaries):
    """No labelled text is left out of the fit for its length."""
    _, clean, bad = dictionaries
    rng = random.Random(8)
    rows = []
    for k in range(240):
        words = rng.choices(clean, k=7_000)
        if k % 2:
            for place in range(0, 7_000, 50):
                words[place:place + 2] = rng.choices(bad, k=2)
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert min(len(t) for _, t in rows) > toxicity.SAMPLE_CHARS
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(240)], LABELS)
    assert area([{"score": r["score"], "toxic": r["doc_id"] % 2} for r in toxicity.toxicity(docs, labels).filter("held_out").collect()], "toxic") > 0.95


def test_language_of_held_out_documents(tables):
    docs, _ = tables
    rows = language.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_ranking_of_grams():
    table = language.letters()
    code = lambda s: sum((1 if c == " " else ord(c)) << 21 * (len(s) - 1 - k) for k, c in enumerate(s))
    found = language.ranked("Ab ab, A", table).tolist()
    counts = {"a": 3, "b": 2, " a": 3, "ab": 2, "b ": 2, "a ": 1, " ab": 2, "ab ": 2, " a ": 1}
    assert found == [c for _, c in sorted((-n, code(g)) for g, n in counts.items())]
    assert not len(language.ranked("12 ?! \n", table)) and not len(language.ranked("", table))


def test_edges_of_trained_operators(spark, odd, odd_labels):
    n = odd.count()
    for found in (quality.quality(odd, odd_labels), toxicity.toxicity(odd, odd_labels)):
        rows = found.collect()
        assert len(rows) == n and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in rows)
        twice = [r["score"] for r in rows if r["doc_id"] == 6]
        assert len(twice) == 2 and len(set(twice)) == 1
    none = odd_labels.limit(0)
    assert {r["score"] for r in quality.quality(odd, none).collect()} == {0.5} == {r["score"] for r in toxicity.toxicity(odd, none).collect()}
    found = {(r["doc_id"], r["lang_pred"]) for r in language.languages(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "und")} <= found and (4, "und") not in found
    assert {r["lang_pred"] for r in language.languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    empty = odd.limit(0)
    for found in (quality.quality(empty, odd_labels), toxicity.toxicity(empty, odd_labels), toxicity.keep_clean(empty, odd_labels), language.languages(empty), lm.score_texts(empty)):
        assert found.count() == 0, found.columns


def test_languages_whose_texts_are_all_long(spark):
    """No labelled text is left out for its length: profiles and predictions equal loops over all n-grams."""
    words = {"en": "the house and the garden were there with this other".split(), "de": "das haus und der garten waren dort mit dieser anderen".split()}
    rows = [(i, " ".join(words[lang][(i * 7 + k * k) % 10] for k in range(12_000)), lang) for i, lang in enumerate(["en", "de"] * 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert min(len(t) for _, t, _ in rows) > 50_000
    assert set(language.profiles(docs)) == {"en", "de"}
    assert all(r["lang_pred"] == rows[r["doc_id"]][2] for r in language.languages(docs).collect())


def test_isotonic_fit():
    x, y = calibration.isotonic([3, 1, 2, 4], [10, 10, 10, 10], [2, 4, 1, 9], prior=0)
    assert list(x) == [2.0, 4.0] and np.allclose(y, [7 / 30, 0.9])
    assert (np.diff(calibration.isotonic(range(50), [3] * 50, [k * 7 % 4 for k in range(50)])[1]) >= 0).all()


# --- language model ----------------------------------------------------------------------------------

def test_base_scores_and_counts_equal_loops(odd, small):
    import re
    import zlib
    for docs in (odd, small):
        rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", (r["text"] or "").translate({k: k + 32 for k in range(65, 91)})) + [" "]) for r in docs.collect()]
        held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 5 == 1
        counts = {}
        for i, w in rows:
            if not held(i):
                for x in w:
                    counts[x] = counts.get(x, 0) + 1
        total, kinds = sum(counts.values()), len(counts)
        want = sorted(((i, held(i), len(w), sum(x in counts for x in w), total,
                        round(sum(math.log10((counts.get(x, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for x in w), 6)) for i, w in rows), key=str)
        found = lm.score_texts(docs).collect()
        assert sorted((tuple(r)[:5] + (round(r["base_score"], 6),) for r in found), key=str) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)


def test_probabilities_sum_to_one():
    """Over all known words and the unknown one, in every context, with sampled seating."""
    draw = np.random.default_rng(0)
    words = 300
    key = np.unique(draw.zipf(1.3, 6000) % words * lm.CONTEXTS + draw.integers(0, lm.CONTEXTS, 6000))
    counts = draw.zipf(1.5, len(key)).clip(1, 5000)
    word, context = key // lm.CONTEXTS, key % lm.CONTEXTS
    present = np.unique(word)
    word = np.searchsorted(present, word)
    key, words = word * lm.CONTEXTS + context, len(present)
    whole = np.bincount(word, weights=counts)
    totals = lm.Totals(np.bincount(context, weights=counts, minlength=lm.CONTEXTS), int(counts.sum()), words, int((whole == 1).sum()),
                       (int((counts == 1).sum()), int((counts == 2).sum())), (10, 10))
    start = lm.Seating(np.bincount(context, minlength=lm.CONTEXTS).astype(float), len(key), words, totals)
    kept = list(lm._sweeps(0, word, context, counts, words, totals, start, 4, 1))[1:]
    for tables, parents, parent_tables in kept:
        assert ((tables >= 1) & (tables <= counts)).all() and ((parent_tables >= 1) & (parent_tables <= parents)).all()
    states = [lm.Seating(np.bincount(context, weights=t, minlength=lm.CONTEXTS), p.sum(), q.sum(), totals) for t, p, q in kept]
    for c in (0, 5, 77):
        asked = np.arange(-1, words)
        found = lm.probabilities(asked, np.full(len(asked), c), key, counts, kept, totals, states)
        assert (found > 0).all() and abs(found.sum() - 1) < 1e-9


def test_seats_follow_their_distribution():
    """Tables of a cell against the exact conditional distribution."""
    ways, draw = lm.stirling(0.6), np.random.default_rng(3)
    for c, weight in ((2, 0.5), (5, 1.7), (9, 0.05)):
        exact = np.exp(ways[c, 1:c + 1] + np.arange(1, c + 1) * np.log(weight))
        found = np.bincount(lm.seat(np.full(40_000, c), np.full(40_000, weight), 0.6, ways, draw), minlength=c + 1)[1:] / 40_000
        assert np.abs(found - exact / exact.sum()).max() < 0.01
    # two customers: together with 1 - d, apart with the weight
    assert abs(np.exp(ways[2, 1]) - 0.4) < 1e-12 and ways[2, 2] == 0
    large = lm.seat(np.full(500, 20_000), np.full(500, 2.0), 0.6, ways, draw)
    assert (large >= 1).all() and large.max() <= 20_000 and large.std() > 0


def test_the_model_beats_single_words_on_held_out_texts(tables):
    rows = lm.score_texts(tables[0]).filter("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, lm.score_texts(tables[0]).filter("held_out").collect()))
