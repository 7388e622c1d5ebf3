"""The pipeline against a plain one: every stage after the classifier row by row."""

import hashlib

import public_tokenizers
from test_forest import shingles
from test_texts import shares
from tokenizers import Tokenizer

import corpus_pipeline
from trafficlens.operators.skew import materialize, new_path, scratch

TILTS = (-0.5, 0.0, 0.5)


def unlike(rows):
    """Smallest id of every component of texts whose sets of five-word runs have a similarity of 0.8 or more."""
    sets, root = {i: shingles(t, 5) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    names = sorted(sets)
    for i in names:
        for j in names:
            common = len(sets[i] & sets[j])
            if i < j and common * 5 >= 4 * (len(sets[i]) + len(sets[j]) - common):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if r == old else r for k, r in root.items()}
    return [r for r in rows if root[r[0]] == r[0]]


def mixed(rows):
    """Rows in training order, each as often as it is taken."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    targets, found = shares(sizes), []
    tilt = {s: TILTS[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    sha = lambda t: hashlib.md5(t.encode()).hexdigest()
    for source, whole in sizes.items():
        start = 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: sha(f"{r[0]} {sha(r[1])}")):
            size, a = len(text.split()), tilt[source]
            for copy in range(3):
                begin = copy * whole + start
                taken = max(0, min(size, int(targets[source]) - begin))
                if taken * 2 >= size and (size or not copy):
                    share = begin / targets[source] if targets[source] else None
                    moment = share if not a or share is None else ((a - 1) + ((1 - a) ** 2 + 4 * a * share) ** 0.5) / (2 * a)
                    found.append((moment is not None, moment or 0.0, i, text))
            start += size
    return [(i, text) for _, _, i, text in sorted(found)]


def test_run_equals_a_plain_pipeline(spark, folder):
    clean = materialize(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder), "test-clean")
    newest = {}
    for r in clean.collect():
        text = r["text"] or ""
        if text not in newest or newest[text][0] < r["doc_id"]:
            newest[text] = (r["doc_id"], text, r["source"])
    want = mixed(unlike(list(newest.values())))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    docs = clean
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = materialize(stage(spark, docs, folder), name.replace(" ", "-"))
    got = docs.orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(len(want)))
    assert [r["doc_id"] for r in got] == [i for i, _ in want]
    for r, (_, text) in zip(got, want):
        assert r["ids"] == library.encode(text, add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
    # the whole run gives the same rows
    run = corpus_pipeline.run(spark, folder).orderBy("position").select("doc_id", "ids_sha256").collect()
    assert [tuple(r) for r in run] == [(r["doc_id"], r["ids_sha256"]) for r in got]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    import os
    with scratch(spark) as keep:
        gone = materialize(spark.range(5), "gone")
        with scratch(spark) as inner:
            kept = inner(materialize(gone.filter("id > 2"), "kept"))
            materialize(spark.range(2), "inner")
        gone_path, kept_path = (os.path.dirname(f.inputFiles()[0].removeprefix("file:")) for f in (gone, kept))
        keep(materialize(kept, "last"))
        outer = new_path(spark, "never-written")
    assert not os.path.exists(gone_path) and not os.path.exists(kept_path) and not os.path.exists(outer)
