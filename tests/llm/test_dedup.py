"""Fingerprints, near duplicates and exact duplicates against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from trafficlens.llm import components, exact, neardup, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, size):
    found = words(text)
    return [" ".join(found[k:k + size]) for k in range(max(1, len(found) - size + 1))] if found else []


def fingerprint(text, size, weight=lambda term: 1):
    votes, total = [0] * 64, 0
    for term in shingles(text, size):
        h, w = xxhash.xxh64_intdigest(term.encode(), 42), weight(term)
        total += w
        for b in range(64):
            votes[b] += w * (h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > total)


def joined(prints, near):
    """Smallest id reachable from each row over links."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if near(prints[i][1], prints[j][1]):
                root[top(i)] = top(j)
    found = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            found[top(i)] = min(found.get(top(i), doc_id), doc_id)
    return [found.get(top(i)) for i in range(len(prints))]


def test_edited_fingerprints_equal_loops(spark, odd, small):
    for docs in (odd, small):
        texts = {}
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        # rows that repeat hold one place
        key = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"),
                          F.xxhash64(F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()
        order = sorted(key, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["h"]))
        for at, r in enumerate(order):
            after = order[(at + 1) % len(order)]["t"]
            n = len(r["t"])
            edited = r["t"][:n - n // 3] + after[:n // 3]
            a, b, c = (fingerprint(t, 2, len) for t in (r["t"], edited, after))
            like = lambda x, y: 1 - (x ^ y).bit_count() / 64
            texts[r["doc_id"], r["t"]] = (n, hashlib.sha256(edited.encode()).hexdigest(), f"{a:016x}", f"{b:016x}", like(a, b), like(a, c))
        want = sorted(((i, *texts[i, t]) for i, t in rows), key=str)
        found = simhash.edited_fingerprints(docs).select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
        assert sorted(map(tuple, found), key=str) == want


def test_block_tables_find_all_within_the_radius(spark):
    draw = random.Random(1)
    centre = [draw.getrandbits(64) for _ in range(20)]
    prints = sorted({c ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(7))) for c in centre for _ in range(20)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fingerprint bigint")
    asked = frame.limit(60)
    chosen = {r[0] % (1 << 64) for r in asked.collect()}
    for radius, blocks in ((3, None), (2, 4), (0, None)):
        found = [(r["query"] % (1 << 64), r["found"] % (1 << 64), r["distance"]) for r in simhash.near(asked, frame, radius, blocks).collect()]
        want = [(a, b, (a ^ b).bit_count()) for a in chosen for b in prints if (a ^ b).bit_count() <= radius]
        assert sorted(found) == sorted(want)


def test_anchors_meet_whenever_two_points_are_near():
    """Every pair within the threshold shares an anchor, and no point has more anchors than the method allows."""
    draw = random.Random(2)
    offsets = {}
    for s, mask in neardup.anchor_offsets(2):
        offsets.setdefault(s, []).append(mask)
    assert max(map(len, offsets.values())) == 33

    def anchors(x):
        s = 0
        for p in range(1, 64):
            if x >> (p - 1) & 1:
                s ^= p
        return {(x ^ mask) % (1 << 64) for mask in offsets[s]}

    for _ in range(400):
        x = draw.getrandbits(64)
        y = x ^ sum(1 << b for b in draw.sample(range(64), draw.randrange(3)))
        assert anchors(x) & anchors(y)


def near_copies(spark):
    """Groups of near copies, some joined only through a third text."""
    draw = random.Random(3)
    rows = []
    for g in range(12):
        base = [f"t{draw.randrange(400)}" for _ in range(260)]
        for _ in range(9):
            rows.append((len(rows) * 3 % 301, " ".join(base), "s"))
            base = list(base)
            base[draw.randrange(len(base))] = f"n{draw.randrange(10 ** 6)}"
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


@pytest.mark.parametrize("name", ["odd", "small", "copies"])
def test_near_duplicates_equal_loops(spark, odd, small, name):
    docs = {"odd": odd, "small": small}.get(name) if name != "copies" else near_copies(spark)
    rows = [(r["doc_id"], fingerprint(r["text"], 3)) for r in docs.collect()]
    want = [(i, f"{p:016x}", c) for (i, p), c in zip(rows, joined(rows, lambda a, b: (a ^ b).bit_count() <= 2))]
    found = [tuple(r) for r in neardup.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    if name == "copies":
        assert 12 <= len({c for _, _, c in want}) < 60
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    stay = [r["doc_id"] for r in kept.collect()]
    assert len(stay) == len({(c, c is None and p) for _, p, c in want}) and {i for i in stay if i is not None} == {c for _, _, c in want if c is not None}


def test_components_of_chains_and_stars(spark):
    chain = [(k, k + 1) for k in range(300)]
    star = [(1000, 1000 + k) for k in range(1, 400)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (5000, 4999)], "a bigint, b bigint").repartition(5)
    found = {}
    for r in components.components(edges).collect():
        found.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, found.values())) == sorted([sorted(range(301)), sorted(range(1000, 1400)), [4999, 5000]])


@pytest.mark.parametrize("tracked", [2048, 64])
def test_exact_duplicates_equal_loops(spark, odd, tracked):
    many = spark.createDataFrame([(k, "same" if k % 3 == 0 else f"t{k // 4}") for k in range(900)] + [(897, "same")] * 3, "doc_id bigint, text string")
    for docs in (odd, many.repartition(40)):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        groups = {}
        for i, t in rows:
            groups.setdefault(t, []).append(i)
        found = [tuple(r) for r in exact.exact_duplicates(docs, tracked).select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
        want = [(i, max((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
        assert sorted(found, key=str) == sorted(want, key=str)
        stay = exact.exact_duplicates(docs, tracked).filter("kept").collect()
        assert sorted(r["text_sha256"] for r in stay) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in groups)
        assert all(r["doc_id"] == r["keep_id"] for r in stay)
        kept = exact.keep_one(docs, tracked)
        assert kept.columns == docs.columns
        assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect() if r["doc_id"] is not None) == sorted(
            (max(x for x in g if x is not None), t) for t, g in groups.items() if any(x is not None for x in g))
    winners = exact.winners(many.select("doc_id", exact.digest("text").alias("digest")), 64)
    assert [r["group_size"] for r in winners.orderBy(F.desc("group_size")).limit(1).collect()] == [303]


def test_empty_tables(odd):
    none = odd.limit(0)
    for job in (simhash.edited_fingerprints, neardup.near_duplicates, neardup.keep_one, exact.exact_duplicates, exact.keep_one):
        assert job(none).count() == 0
