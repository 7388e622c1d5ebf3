"""Fill-in-the-middle against plain loops, and the skip list against counting."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trafficlens.llm import middle

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def by_loop(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, mid, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(mid), f"<S>{suffix}<P>{prefix}<M>{mid}"
    return len(units), "psm", len(prefix), len(mid), f"<P>{prefix}<S>{suffix}<M>{mid}"


def key(row):
    return tuple((v is None, v) for v in row)


def test_rows_equal_loops(spark, odd, small):
    hard = [(k, t, None, None, None) for k, t in enumerate(["<", "<S", "a<S>b", "x<P", "<M>", "S>", "\n\r\n", "a\x00b", "été 漢字 𝒜𝒷 é", "𝒜" * 9, "aZ[`{@", "A", " "] * 20)]
    for docs in (odd, small, spark.createDataFrame(hard, "doc_id bigint, text string, lang string, source string, n_chars bigint")):
        want = [(r["doc_id"], *by_loop(r["doc_id"], r["text"])) for r in docs.collect()]
        assert sorted(map(key, middle.fill_in_middle(docs).collect())) == sorted(map(key, want))
        sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
        texts = [(r["doc_id"], sha(r["text"])) for r in docs.collect()]
        got = middle.middle_digests(docs).select("doc_id", "restored_sha256").collect()
        assert sorted(map(key, got)) == sorted(map(key, texts))


def test_marks_next_to_cuts_are_restored(spark):
    rows = [("<S>>x<P><S<M>P>", "spm", "<SP>>x"), ("a<S>b", "plain", "a<S>b"), ("<P><S><M>x", "psm", "x")]
    frame = spark.createDataFrame(rows, "output string, form string, text string")
    assert frame.filter(middle.restored("output", "form") != F.col("text")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 1000, 50_000])
def test_skip_list_finds_every_rank(n):
    widths = np.random.default_rng(n).integers(1, 9, n)
    found = middle.SkipList(widths)
    ends = [0, *np.cumsum(widths).tolist()]
    ranks = range(n + 1) if n <= 1000 else range(0, n + 1, 97)
    assert [found.offset(r) for r in ranks] == [ends[r] for r in ranks]
    # links of every lane pass over all units, and lanes thin out
    for units, points, _ in found.lanes[:-1]:
        assert units.sum() <= n and (points > 0).all()
    if n >= 1000:
        assert 4 <= len(found.lanes) <= 14 and len(found.lanes[1][0]) < n / 3


def test_empty_table(spark, odd):
    assert middle.middle_digests(odd.limit(0)).collect() == []
