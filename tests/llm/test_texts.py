"""Mixing, tokens, archives and the pipeline."""

import base64
import gzip
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from check import rows_of
from trafficlens.llm import bpe, catalog, hot, mixing, warc
from trafficlens.operators.skew import materialize, new_path

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_queries_equal_sql(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "pages"):
        db.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    frame, found = catalog.QUERIES[name](spark, folder), db.execute(catalog.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(frame.columns) and rows_of(frame.columns, frame.collect()) == rows_of(columns, found.fetchall())


# --- mixing ----------------------------------------------------------------------------------------

def shares(sizes):
    """Targets by sharing again and again what stopped sources leave over."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full: dict = {}
    while True:
        rest = sum(sizes.values()) - sum(full.values())
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s: 3 * sizes[s] for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return full | share
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken_words(spark, seed):
    draw = random.Random(seed)
    rows = [(k, " ".join("w" * draw.randrange(draw.choice([2, 40]))), draw.choice(["a", "b", "B", "é", None, "z"] if seed else ["a"])) for k in range(400)]
    rows += [(k, "x y", "huge") for k in range(400, 1600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    found = {r["doc_id"]: r for r in mixing.mix(docs, piece_rows=50).collect()}
    sizes, taken = {}, {}
    for i, text, source in rows:
        assert found[i]["size"] == len(text.split()) and 0 <= found[i]["taken"] <= 3 * found[i]["size"]
        sizes[source] = sizes.get(source, 0) + len(text.split())
        taken[source] = taken.get(source, 0) + found[i]["taken"]
    want = shares(sizes)
    for i, _, source in rows:
        assert abs(found[i]["target"] - want[source]) < 1e-6 and found[i]["source_size"] == sizes[source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(9), piece_rows=7).collect()
    assert {r["doc_id"]: tuple(r) for r in again} == {i: tuple(r) for i, r in found.items()}
    assert [r["position"] for r in again if r["position"] is not None] == sorted(r["position"] for r in again if r["position"] is not None)


def test_moments_invert_demand(spark):
    frame = spark.range(0, 101).selectExpr("id / 100D as t")
    for tilt in (-0.5, 0.0, 0.5):
        demand = F.lit(80.0) * (F.col("t") + F.lit(tilt) * (F.col("t") * F.col("t") - F.col("t")))
        assert frame.select(F.max(F.abs(mixing.due(demand, F.lit(80.0), F.lit(tilt)) - F.col("t")))).first()[0] < 1e-12


def test_mixed_rows(spark, odd):
    found = mixing.mixed(odd)
    assert found.columns == odd.columns
    times = {}
    for r in found.collect():
        times[r["doc_id"], r["text"]] = times.get((r["doc_id"], r["text"]), 0) + 1
    assert max(times.values()) <= 6 and times[8, odd.filter("doc_id = 8").first()["text"]] >= 1
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(odd.limit(0)).count() == 0 == mixing.mixed(odd.limit(0)).count()


# --- tokens ----------------------------------------------------------------------------------------

def samples():
    draw = random.Random(4)
    kinds = [(97, 123), (97, 123), (65, 91), (32, 127), (0xC0, 0x250), (0x370, 0x3FF), (0x4E00, 0x4F00), (0x1F600, 0x1F640)]
    mixed = ["".join(chr(draw.randrange(*draw.choice(kinds))) for _ in range(draw.randrange(50))) for _ in range(1500)]
    long = ["".join(draw.choice("aeioulnrst") for _ in range(n)) for n in (199, 200, 201, 202, 900, 5000)]
    return [*mixed, *long, "", "  ", "fffffffff", "a" * 333, "ΟΔΟΣ Σας", "x<|endoftext|>Y <|startoftext|><|ENDOFTEXT|>", "it's WE'LL 'Tis can't '", "é Å ﬁ İ", "a\x1cb\x85c　d"]


def test_tokens_equal_the_library(small):
    library = Tokenizer.from_file(WORDS)
    library.no_padding()
    library.no_truncation()
    texts = samples() + [r["text"] or "" for r in small.collect()]
    with open(WORDS, "rb") as file:
        encoder = bpe.Encoder(file.read(), remembered=500)
    for start in range(0, len(texts), 97):
        part = texts[start:start + 97]
        for text, ids, want in zip(part, encoder.encode(part), library.encode_batch(part, add_special_tokens=False)):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
            assert encoder.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_token_digests(odd):
    library = Tokenizer.from_file(WORDS)
    found = bpe.token_digests(odd, WORDS).collect()
    want = []
    for r in odd.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert bpe.token_digests(odd.limit(0), WORDS).count() == 0
    assert {r["doc_id"]: len(r["ids"]) for r in bpe.token_ids(odd, WORDS).filter("doc_id > 6").collect()} == {r[0]: r[1] for r in want if (r[0] or 0) > 6}


# --- archives --------------------------------------------------------------------------------------

PAGES = [(5, "http://a/", "same"), (3, "http://b/ x\r\ny", "same"), (9, None, "same"), (4, "u", None), (6, "u", ""), (7, "u", "\r\n\r\nWARC/1.1\r\n\r\n"),
         (8, "u", "ends\r\n"), (10, "u", "ends\r\n\r\n"), (11, "u", "\r\n"), (12, "u", "é\x00ß" * 30_000), (None, "u", "same"), (None, "u", "alone"),
         (20, "u", "twice"), (20, "u", "twice"), (21, "u", "\n\n\r\r\n\n"), (22, "u", "twice")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "'x' as digest", "1 as record").repartition(3)
    path = new_path(spark, "test-warc")
    found = sorted((tuple(r)[:5] for r in warc.archive_pages(pages, least, path).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None) if len(data) >= least else i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        revisit = first is not None and i != first and len([1 for _, _, h in PAGES if (h or "") == (html or "")]) > 1
        want.append((i, len(data), digest, "revisit" if revisit else "response", first if revisit else None))
    assert found == sorted(want, key=str)
    files = [p[0] for p in spark.read.format("binaryFile").load(path).select("path").collect()]
    whole = b"".join(gzip.open(f.removeprefix("file:")).read() for f in files if f.endswith(".gz"))
    assert whole.count(b"\r\nWARC-Type: ") == len(PAGES) and whole.endswith(b"\r\n\r\n")
    headers = warc.read_headers(spark, path)
    assert headers.filter("record_type = 'revisit'").join(headers.select(F.col("record_id").alias("refers_to_id")), "refers_to_id", "left_anti").count() == 0


@pytest.mark.parametrize("html", ["ends\r\n", "\r\n", "ends\r\n\r\n", "ends\r\n\r\n\r\n", "ends\r\n\r", "ends\n"])
def test_last_record_ends_in_line_breaks(spark, html):
    pages = spark.createDataFrame([(1, "u", html)], "page_id bigint, url string, html string")
    digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
    assert [tuple(r)[:4] for r in warc.archive_pages(pages).collect()] == [(1, len(html), digest, "response")]


def test_one_payload_that_most_pages_share(spark):
    """The group is joined on the map side, in writing and in reading; every page comes out as it would from a plain join."""
    html = lambda i: "" if i % 10 else f"page {i % 70}"
    pages = spark.createDataFrame([(i, "u", html(i)) for i in range(3000, 0, -1)], "page_id bigint, url string, html string").repartition(6)
    found = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.archive_pages(pages).collect()}
    first = {}
    for i in range(1, 3001):
        first.setdefault(html(i), i)
    assert found == {i: ("response", None, len(html(i))) if first[html(i)] == i else ("revisit", first[html(i)], len(html(i))) for i in range(1, 3001)}


@pytest.mark.parametrize("share", [2.0, 1 / 256, 0.0])
def test_joins_of_repeated_keys(spark, monkeypatch, share):
    """Whatever counts as hot, a join gives the rows of a plain left join."""
    monkeypatch.setattr(hot, "HOT_SHARE", share)
    rows = spark.createDataFrame([(k, None if k % 11 == 0 else "big" if k % 3 else f"s{k % 40}") for k in range(500)], "i bigint, k string")
    table = materialize(rows.filter("k is not null and k <> 's9'").groupBy("k").agg(F.count(F.lit(1)).alias("c"), F.min("i").alias("low")), "test-counted")
    found = hot.join_counted(rows, table, "k", "c").select("i", "k", "low").collect()
    assert sorted(map(str, found)) == sorted(map(str, rows.join(table, "k", "left").select("i", "k", "low").collect()))


def test_no_pages(spark):
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# --- pipeline --------------------------------------------------------------------------------------

def test_every_stage_works_on_what_the_last_one_kept(spark, folder, odd):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {(r["doc_id"], r["text"]) for r in docs.collect()}
        found = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert found.columns == docs.columns and {(r["doc_id"], r["text"]) for r in found.collect()} <= before
        else:
            assert found.count() == docs.count()
        docs = found
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, folder).count() > 0 and stage(spark, odd.limit(0), folder).count() == 0
