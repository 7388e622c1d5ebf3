"""Raw HTTP text: reading, parsing, bodies, pseudo-sessions, attack types."""

import hashlib
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from trafficlens.config import HttpTextSettings
from trafficlens.operators.features import session_features
from trafficlens.operators.skew import number_rows
from trafficlens.sources import http_text

TEXT = ("get /a?x=1 HTTP/1.0\nHost: one:80\nUser-Agent: Café\nHOST: two\nnot a header\n\n"
        "POST /api/p HTTP/1.1\nUser-Agent: B\nContent-Length: 5\n\nid=12\n \t \n"
        "FETCH /no HTTP/1.1\nUser-Agent: C\n\n\n\nGET /rest/x\n\nonly\n\nDELETE /d HTTP/1.1\n")


@pytest.fixture(scope="module")
def path():
    folder = tempfile.mkdtemp(prefix="trafficlens-test-")
    for name in ("plain.txt", "crlf.txt"):
        text = TEXT if name == "plain.txt" else TEXT.replace("\n", "\r\n")
        with open(os.path.join(folder, name), "w", encoding="latin-1", newline="") as f:
            f.write(text)
    return folder


@pytest.mark.parametrize("name", ["plain.txt", "crlf.txt"])
def test_blocks_and_parsing(spark, path, name):
    blocks = http_text.read_blocks(spark, f"{path}/{name}")
    assert blocks.count() == 7
    rows = http_text.parse_blocks(blocks).orderBy(*http_text.BLOCK_ORDER).collect()
    assert [(r["method"], r["url"], r["version"]) for r in rows] == [
        ("GET", "/a?x=1", "HTTP/1.0"), ("POST", "/api/p", "HTTP/1.1"), ("GET", "/rest/x", "HTTP/1.1"),
        ("DELETE", "/d", "HTTP/1.1")]
    assert rows[0]["headers"] == {"host": "two", "user-agent": "Café"}
    assert [r["user_agent"] for r in rows] == ["Café", "B", "", ""]
    assert all(r["body"] == "" for r in rows)


def test_bodies_can_be_attached(spark, path):
    blocks = http_text.attach_bodies(http_text.read_blocks(spark, f"{path}/plain.txt"))
    rows = http_text.parse_blocks(blocks).orderBy(*http_text.BLOCK_ORDER).collect()
    assert [(r["method"], r["body"]) for r in rows] == [
        ("GET", ""), ("POST", "id=12"), ("GET", "only"), ("DELETE", "")]


def test_many_small_splits_lose_nothing(spark):
    folder = tempfile.mkdtemp(prefix="trafficlens-test-")
    with open(f"{folder}/big.txt", "w") as f:
        f.write("\n\n".join(f"GET /p/{i} HTTP/1.1\nUser-Agent: a{i}\nX: {'y' * (i % 50)}" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert spark.read.text(f"{folder}/big.txt").rdd.getNumPartitions() > 8
        parsed = http_text.parse_blocks(http_text.read_blocks(spark, f"{folder}/big.txt"))
        numbered = number_rows(parsed, [F.col(c) for c in http_text.BLOCK_ORDER])
        found = {r["row_no"]: r["url"] for r in numbered.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == {i + 1: f"/p/{i}" for i in range(3000)}


def test_line_ends_and_splits_do_not_matter(spark):
    """LF and CRLF files in one folder, separators with blanks, two split sizes, two folders: equal rows."""
    found = []
    for split in ("4096", "100000000"):
        folder = tempfile.mkdtemp(prefix="trafficlens-test-")
        for name, eol in (("lf.txt", "\n"), ("crlf.txt", "\r\n")):
            gap = f"{eol} \t{eol}{eol}" if name == "crlf.txt" else eol * 2
            blocks = [f"GET /q/{i}?x={i % 7} HTTP/1.1{eol}User-Agent: u{i % 5}{eol}X: {'y' * (i % 90)}" for i in range(700)]
            with open(f"{folder}/{name}", "w", newline="") as f:
                f.write(eol + gap.join(blocks) + eol)
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        try:
            blocks = http_text.read_blocks(spark, folder).withColumn("label", F.lit(1))
            rows = http_text.to_requests(http_text.parse_blocks(blocks))
            found.append(sorted((os.path.basename(r["file"]), r["block_no"], r["url"], r["user_agent"], r["status_code"], r["response_size_bytes"])
                                for r in rows.collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found[0] == found[1] and len(found[0]) == 1400
    assert [r[1:3] for r in found[0]] == [(i + 1, f"/q/{i}?x={i % 7}") for i in range(700)] * 2
    assert len({r[4] for r in found[0]}) > 2


def test_missing_file_is_an_error(spark, path):
    with pytest.raises(AnalysisException):
        http_text.load_labelled(spark, path).count()


def _folder(counts=(45, 15, 30)):
    folder = tempfile.mkdtemp(prefix="trafficlens-test-")
    names = HttpTextSettings()
    for name, n in zip((names.normal_train_file, names.normal_test_file, names.anomalous_file), counts):
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n\n".join(f"GET /{name[:3]}/{i} HTTP/1.1" + (f"\nUser-Agent: ua{i}" if i % 3 else "") for i in range(n)))
    return folder


def test_sessions_of_labelled_files(spark):
    folder = _folder()
    rows = http_text.load_sessions(spark, folder).collect()
    assert len(rows) == 90
    normal = sorted((r for r in rows if r["label"] == 0), key=lambda r: r["row_no"])
    attack = sorted((r for r in rows if r["label"] == 1), key=lambda r: r["row_no"])
    # training file and test file are numbered in path order, whole sessions of 20
    assert len({r["session_id"] for r in normal}) == 3 and len({r["session_id"] for r in attack}) == 2
    assert normal[25]["session_id"] == hashlib.md5(b"10.1.0.220").hexdigest()[:12]
    assert normal[25]["ip"] == "10.1.0.2" and attack[0]["ip"] == "10.2.0.1"
    assert {r["traffic_class"] for r in normal} == {"human"} and {r["traffic_class"] for r in attack} == {"scraper"}
    assert normal[20]["timestamp_ms"] == 1.7e12 + 20 * 5000
    gaps = [b["timestamp_ms"] - a["timestamp_ms"] for a, b in zip(normal, normal[1:]) if a["session_id"] == b["session_id"]]
    assert min(gaps) >= 100 and 1500 < sum(gaps) / len(gaps) < 2500
    again = http_text.load_sessions(spark, folder).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert {r["status_code"] for r in normal} == {200} and {r["status_code"] for r in attack} <= {200, 400, 403, 500}


def test_file_order_is_numbered_without_a_sort_of_all_rows(spark, monkeypatch):
    """Runs of seven block numbers, blocks that are no requests between them, one name twice in a header: against a loop."""
    def sorts(*_):
        raise AssertionError("all rows are sampled and sorted")

    monkeypatch.setattr(http_text, "number_rows", sorts)
    monkeypatch.setattr(http_text, "NUMBERED_TOGETHER", 7, raising=False)
    folder, names, want = tempfile.mkdtemp(prefix="trafficlens-test-"), HttpTextSettings(), {0: [], 1: []}
    # files of a label are in order of their paths
    for name, label, n in sorted(((names.normal_train_file, 0, 50), (names.normal_test_file, 0, 33), (names.anomalous_file, 1, 25))):
        blocks = []
        for i in range(n):
            # no request in the third run at all
            asked = i % 4 != 3 and not 14 <= i < 21
            blocks.append(f"GET /{name[:8]}/{i} HTTP/1.1\nA: {i}\n a : last" if asked else f"note {i}")
            if asked:
                want[label].append(f"/{name[:8]}/{i}")
        with open(f"{folder}/{name}", "w") as f:
            f.write("\n\n".join(blocks))
    rows = http_text.load_sessions(spark, folder).collect()
    for label, urls in want.items():
        found = sorted((r for r in rows if r["label"] == label), key=lambda r: r["row_no"])
        assert [(r["row_no"], r["url"]) for r in found] == list(enumerate(urls, 1))
        assert [r["session_id"] for r in found] == [found[k // 20 * 20]["session_id"] for k in range(len(found))]
    assert {str(r["headers"]) for r in rows} == {str({"a": "last"})}


def test_caps_shuffle_and_features(spark):
    folder = _folder()
    capped = http_text.load_sessions(spark, folder, max_normal=1, max_anomalous=1)
    assert capped.count() == 40
    mixed = http_text.load_sessions(spark, folder, shuffle=True)
    assert sorted(r["url"] for r in mixed.collect()) == sorted(r["url"] for r in http_text.load_sessions(spark, folder).collect())
    assert session_features(mixed).count() == 5


@pytest.mark.parametrize("text,kind", [
    ("/a?id=1'%20OR%20--", "sql_injection"), ("/a?q=<script>", "xss"), ("/a?f=../../x", "path_traversal"),
    ("/a?c=x;ls", "command_injection"), ("/a?b=" + "A" * 500, "buffer_overflow"), ("/a", "other_anomaly"),
    ("/a?x=UNION", "sql_injection"), ("/a?x=' OR 1", "sql_injection"), ("/a?q=JavaScript:x", "xss"), ("/a?q=\u017felect", "sql_injection"), ("/a?q=\u0131nsert", "sql_injection"),
    ("/a?x='\n\t oR", "sql_injection"), ("/a?b=" + "A" * 499 + "&c=" + "B" * 490, "other_anomaly"),
    ("/a?b=" + "A" * 300 + "&" + "B" * 500, "buffer_overflow"), ("A" * 500, "buffer_overflow"), ("/a%0Db", "command_injection")])
def test_attack_types(spark, text, kind):
    row = http_text.with_attack_type(spark.createDataFrame([(text,)], "t string"), F.col("t")).first()
    assert row["attack_type"] == kind


def test_breakdown_is_sorted(spark):
    rows = spark.createDataFrame([("/a", ""), ("/b", None), ("/c", "x=<script>")], "url string, body string")
    assert [tuple(r) for r in http_text.attack_breakdown(rows).collect()] == [("other_anomaly", 2), ("xss", 1)]


def test_pieces_do_not_depend_on_batches():
    """Runs of lines with text in every split, against a loop; splits of blanks, runs at both ends, batches of any size."""
    import pyarrow as pa
    rows = [(f, s, f"{f}{s}.{k}" if c == "x" else " ", c == "x") for f, s, lines in
            (("a", 0, "xx.x"), ("a", 9, "xxxx"), ("a", 20, "..."), ("a", 30, ".x..xx"), ("b", 30, "x"), ("b", 40, "x.x.")) for k, c in enumerate(lines)]
    want, split, seen = [], None, 0
    for k, (f, s, line, text) in enumerate(rows):
        entered, (split, seen) = (f, s) != split, ((f, s), 0 if (f, s) != split else seen)
        if text and (entered or not rows[k - 1][3]):
            seen += not entered
            want.append([f, s, seen, [line]])
        elif text:
            want[-1][3].append(line)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(4)], ["file", "split_start", "line", "text"])
    for size in (1, 2, 3, 5, len(rows)):
        found = [r for b in http_text._pieces(iter([batch.slice(k, size) for k in range(0, len(rows), size)])) for r in b.to_pylist()]
        assert [[r["file"], r["split_start"], r["seen"], r["block"].split("\n")] for r in found if r["block"]] == want
        ends = {(r["file"], r["split_start"]): (r["seen"], r["lead"], r["tail"]) for r in found if r["block"] is None}
        assert ends == {("a", 0): (1, True, True), ("a", 9): (0, True, True), ("a", 20): (0, False, False), ("a", 30): (2, False, True), ("b", 30): (0, True, True), ("b", 40): (1, True, False)}
        assert {r["block"] for r in found if r["block"] and (r["ends"] or r["lead"])} == {"a0.0\na0.1", "a0.3", "a9.0\na9.1\na9.2\na9.3", "a30.4\na30.5", "b30.0", "b40.0"}
