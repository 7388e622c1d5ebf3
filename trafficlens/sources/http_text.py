"""Raw HTTP request text: read blocks, parse, turn into request rows, group into pseudo-sessions."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trafficlens.config import DEFAULT, Settings
from trafficlens.functions.columns import attack_type, fold_case
from trafficlens.operators.skew import materialize, number_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Accepted methods, api path parts, statuses of attack requests, agent when none is sent.
METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD", "OPTIONS", "PATCH")
API_PARTS = ("/api/", "/rest/", "/json/", "/xml/")
ATTACK_STATUSES = (200, 400, 403, 500, 200, 200)
DEFAULT_AGENT = "Mozilla/5.0 (CSIC-2010)"

BLOCK_ORDER = ("file", "block_no")
SPACES = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0"


# blocks of a file that are numbered in one window
NUMBERED_TOGETHER = 10_000


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    # the left end decides: a line with text is not looked through to its end
    return F.ltrim(text, F.lit(SPACES)) == ""


PIECES = "file string, split_start bigint, seen bigint, ends boolean, lead boolean, tail boolean, block string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, split_start, line, text) in file order to the runs of lines with text in every split.

    `seen` counts the begins in the split up to the run; a run at the first line of its split has begun before (0).
    After the runs of a split comes one row without block: its begins, and whether its first and last line have text.
    """
    # rows of the run that is still open, and what is known of its split
    held: list[pa.RecordBatch] = []
    split, seen, lead, text_before = None, 0, False, False

    def flushed() -> list[tuple]:
        return [] if split is None else [(*split, seen, True, lead, text_before, None)]

    for batch in batches:
        if not len(batch):
            continue
        if held and batch.column(3).false_count == 0 and pc.all(pc.and_(pc.equal(batch.column(0), split[0]), pc.equal(batch.column(1), split[1]))).as_py():
            # all of it goes on with the open run
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0] if held else batch
        skipped, held = len(rows) - len(batch), []
        file, start = rows.column(0), rows.column(1).to_numpy()
        text = rows.column(3).to_numpy(zero_copy_only=False).astype(bool)
        n = len(rows)
        enters = np.ones(n, bool)
        enters[1:] = (start[1:] != start[:-1]) | pc.not_equal(file.slice(1), file.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        opens = text & (enters | ~np.append(False, text[:-1]))
        closes = text & np.append(enters[1:] | ~text[1:], True)
        # a run that goes on from the batch before was counted there
        enters[0] = not skipped and (file[0].as_py(), int(start[0])) != split
        lines, found = rows.column(2), []
        firsts, lasts = np.flatnonzero(opens), np.flatnonzero(closes)
        at = np.flatnonzero(enters)
        runs = iter(zip(firsts.tolist(), lasts.tolist()))
        run = next(runs, None)
        for k, until in zip([0, *at[at > 0].tolist()], [*at[at > 0].tolist(), n]):
            if enters[k]:
                found += flushed()
                split, seen, lead, text_before = (file[k].as_py(), int(start[k])), 0, bool(text[k]), False
            while run is not None and run[0] < until:
                first, last = run
                new = not (first == 0 and skipped)
                if new and not (first == k and enters[k]):
                    seen += 1
                if last == n - 1:
                    # more of it may follow
                    held = [rows.slice(first)]
                else:
                    found.append((*split, seen, last == until - 1, seen == 0, False, (first, last)))
                run = next(runs, None)
            text_before = bool(text[until - 1])
        if found:
            yield _piece_rows(found, lines)
    if held:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        yield _piece_rows([(*split, seen, True, seen == 0, False, (0, len(rows) - 1))], rows.column(2))
    if split is not None:
        yield _piece_rows(flushed(), pa.array([], pa.string()))


def _piece_rows(found: list[tuple], lines: pa.Array) -> pa.RecordBatch:
    """Rows of PIECES; the last of each tuple are the first and the last of its lines, or None."""
    spans = [f[-1] or (0, -1) for f in found]
    sizes = np.array([b - a + 1 for a, b in spans])
    at = np.repeat(np.array([a for a, _ in spans]) - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, lines.take(pa.array(at, pa.int64()))), "\n")
    blocks = pc.if_else(pa.array([f[-1] is not None for f in found]), joined, pa.scalar(None, pa.string()))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([*[pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)], blocks],
                                      ["file", "split_start", "seen", "ends", "lead", "tail", "block"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blank-line separated blocks of Latin-1 text files: file, block_no (from 1 in each file), block.

    Spark splits files into lines, whatever their line ends and wherever a task begins. A block begins at a
    line with text after a blank line or at the start of the file. Every task puts the lines of its splits together, in the
    order in which it reads them, so lines are never shuffled; only what touches an end of a split meets
    its other parts. Begins are counted inside each split and the counts of the splits before are added, so numbers do not
    depend on how the file was split, and no task sees a whole file.
    """
    lines = (spark.read.text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"),
                     F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line"))
             .withColumn("text", ~is_blank(F.col("line"))))
    pieces = materialize(lines.mapInArrow(_pieces, PIECES), "pieces")
    # one row per split
    by_split = Window.partitionBy("file").orderBy("split_start")
    splits = pieces.filter("block is null").withColumn(
        "entered", (F.col("lead") & ~F.coalesce(F.lag("tail").over(by_split), F.lit(False))).cast("bigint"))
    before = F.coalesce(F.sum(F.col("seen") + F.col("entered")).over(by_split.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialize(splits.select("file", "split_start", (before + F.col("entered")).alias("offset")), "offsets")
    numbered = (pieces.filter("block is not null").join(F.broadcast(offsets), ["file", "split_start"])
                .select("file", (F.col("offset") + F.col("seen")).alias("block_no"), "split_start", "block", (F.col("ends") | F.col("lead")).alias("edge")))
    cut = numbered.filter("edge").groupBy("file", "block_no").agg(F.sort_array(F.collect_list(F.struct("split_start", "block"))).alias("l"))
    whole = numbered.filter("not edge").select("file", "block_no", "block").unionAll(cut.select("file", "block_no", F.array_join("l.block", "\n")))
    return whole.select("file", "block_no", strip(F.col("block")).alias("block"))


def _is_request(block: Column) -> Column:
    words = F.split(F.substring_index(block, "\n", 1), " ", 3)
    return (F.size(words) >= 2) & F.upper(F.get(words, F.lit(0))).isin(*METHODS)


def attach_bodies(blocks: DataFrame) -> DataFrame:
    """Append a block that is no request to the request block right before it.

    A blank line before a body makes the body a block of its own; this puts it back. Only such blocks are
    moved, to the number before theirs.
    """
    bodies = (blocks.filter(~_is_request(F.col("block")))
              .select("file", (F.col("block_no") - 1).alias("block_no"), F.col("block").alias("_body")))
    joined = F.when(F.col("_body").isNotNull(), F.concat("block", F.lit("\n\n"), "_body")).otherwise(F.col("block"))
    return blocks.join(bodies, ["file", "block_no"], "left").withColumn("block", joined).select(*blocks.columns)


def parse_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks to method, url, version, headers, body and user_agent; others are dropped.

    Header names are lower-cased and the last of several equal names wins.
    """
    lines = F.split(F.col("block"), "\n")
    words = F.split(strip(F.substring_index("block", "\n", 1)), " ", 3)
    rest = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    blank = F.array_position(F.transform("_rest", is_blank), True)
    head = F.when(F.col("_blank") > 0, F.slice("_rest", F.lit(1), F.col("_blank").cast("int") - 1)).otherwise(F.col("_rest"))
    tail = F.when(F.col("_blank") > 0, F.slice("_rest", F.col("_blank").cast("int") + 1, F.size("_rest"))).otherwise(
        F.array().cast("array<string>"))

    def pair(line: Column) -> Column:
        return F.struct(F.lower(strip(F.substring_index(line, ":", 1))).alias("key"),
                        strip(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"))

    def first_of_name(head: Column) -> Column:
        # names as a field of a bound variable are listed once a block; as a column they would be put together for every pair
        return F.filter(head["_pairs"], lambda p, i: F.array_position(head["keys"], p["key"]) == i + 1)

    parsed = (blocks
              .withColumn("_lines", lines).withColumn("_words", words)
              .filter((F.size("_words") >= 2) & F.upper(F.get("_words", F.lit(0))).isin(*METHODS))
              .withColumn("_rest", rest).withColumn("_blank", blank)
              # newest first, and of every name the first one is kept
              .withColumn("_pairs", F.reverse(F.transform(F.filter(head, lambda x: F.contains(x, F.lit(":"))), pair)))
              .withColumn("_pairs", F.get(F.transform(F.array(F.struct("_pairs", F.col("_pairs.key").alias("keys"))), first_of_name), F.lit(0))))
    return (parsed
            .withColumn("headers", F.map_from_entries("_pairs"))
            .withColumn("body", strip(F.array_join(tail, "\n")))
            .select(*[c for c in blocks.columns if c != "block"],
                    F.upper(F.get("_words", F.lit(0))).alias("method"),
                    F.get("_words", F.lit(1)).alias("url"),
                    F.coalesce(F.get("_words", F.lit(2)), F.lit("HTTP/1.1")).alias("version"),
                    "headers", "body",
                    F.coalesce(F.try_element_at("headers", F.lit("user-agent")), F.lit("")).alias("user_agent")))


def _number(*parts: Column, below: int) -> Column:
    """A repeatable whole number from 8 hex digits of an MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint") % below


def to_requests(parsed: DataFrame, seed: int = 42) -> DataFrame:
    """Adds the request columns that the text does not carry.

    Attack requests get a status from a seeded hash of the request itself, others 200: equal requests get
    equal statuses, wherever their file lies and however it is split.
    """
    pick = _number(F.col("method"), F.col("url"), F.col("user_agent"), F.col("body"), F.lit(str(seed)), below=len(ATTACK_STATUSES)).cast("int")
    statuses = F.array(*[F.lit(s) for s in ATTACK_STATUSES])
    api = reduce(Column.__or__, [F.col("url").contains(p) for p in API_PARTS])
    return parsed.select(
        "*", F.when(F.col("label") == 1, F.get(statuses, pick)).otherwise(200).alias("status_code"),
        F.lit(80.0).alias("response_time_ms"),
        (F.length("body") + 200).cast("bigint").alias("request_size_bytes"),
        (_number(F.col("url"), below=50000) + 5000).alias("response_size_bytes"),
        api.alias("is_api"), F.lit(None).cast("string").alias("referrer"))


def load_file(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Labelled blocks of one file; a missing path raises AnalysisException."""
    return read_blocks(spark, path).withColumn("label", F.lit(label))


def load_labelled(spark: SparkSession, folder: str, config: Settings = DEFAULT) -> DataFrame:
    """The three files of the layout as request rows: normal, normal, attack."""
    h = config.http_text
    files = ((h.normal_train_file, 0), (h.normal_test_file, 0), (h.anomalous_file, 1))
    blocks = reduce(DataFrame.unionByName, [load_file(spark, f"{folder}/{name}", label) for name, label in files])
    if h.attach_body:
        blocks = attach_bodies(blocks)
    return to_requests(parse_blocks(blocks), h.seed)


def cap_requests(numbered: DataFrame, max_sessions: int | None, session_size: int) -> DataFrame:
    """The first max_sessions * session_size rows of a numbered frame; all when there is no cap."""
    return numbered if not max_sessions else numbered.filter(F.col("row_no") <= max_sessions * session_size)


def request_text(parsed: DataFrame) -> Column:
    """What signatures are searched in: url and body."""
    return F.concat_ws(" ", parsed["url"], F.coalesce(parsed["body"], F.lit("")))


def with_attack_type(rows: DataFrame, text: Column) -> DataFrame:
    """Adds attack_type of a text."""
    staged = rows.withColumn("_text", text).withColumn("_folded", fold_case(F.col("_text")))
    return (staged.withColumn("attack_type", attack_type(F.col("_text"), F.col("_folded")))
            .drop("_text", "_folded"))


def attack_breakdown(rows: DataFrame, text: Column | None = None) -> DataFrame:
    """Rows per attack type, most frequent first; the text of parsed requests unless given."""
    kinds = with_attack_type(rows, request_text(rows) if text is None else text)
    return (kinds.groupBy("attack_type").agg(F.count(F.lit(1)).alias("n_requests"))
            .orderBy(F.desc("n_requests"), "attack_type"))


def _unit(seed: int, stream: str) -> Column:
    """A repeatable number in (0, 1) per row number, from 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(stream), F.col("row_no"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def normal_gap(mean: float, std: float, seed: int) -> Column:
    """Normal deviate per row number by Box and Muller, at least 100 ms."""
    radius = F.sqrt(F.log(_unit(seed, "r")) * -2.0)
    return F.greatest(F.lit(100.0), F.lit(mean) + std * radius * F.cos(_unit(seed, "a") * (2.0 * math.pi)))


def pseudo_sessions(numbered: DataFrame, session_size: int = 20, gap_ms: float = 2000.0,
                    gap_std_ms: float = 800.0, ip_prefix: str = "10.0", seed: int = 42) -> DataFrame:
    """Every `session_size` consecutive rows of a numbered frame form a session.

    Input has row_no, label, user_agent and the columns of a request. Window groups hold at most
    `session_size` rows.
    """
    index = F.floor((F.col("row_no") - 1) / session_size)
    number = index + 1
    ip = F.concat_ws(".", F.lit(ip_prefix), F.floor(number / 256) % 256, number % 256)
    first_row = (index * session_size).cast("string")
    # ip addresses repeat after 65536 sessions, the session id does not: it includes the row offset
    placed = (numbered.withColumn("_session", index).withColumn("position", (F.col("row_no") - 1) % session_size)
              .withColumn("ip", ip).withColumn("session_id", F.substring(F.md5(F.concat("ip", first_row)), 1, 12))
              .withColumn("start_time_ms", F.lit(1.7e12) + index * (session_size * 5000.0)))
    whole = Window.partitionBy("_session")
    upto = Window.partitionBy("_session").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    named = F.when(F.col("user_agent") != "", F.struct("row_no", "user_agent"))
    gap = F.when(F.col("position") > 0, normal_gap(gap_ms, gap_std_ms, seed)).otherwise(0.0)
    majority = F.when(F.sum("label").over(whole) * 2 > F.count(F.lit(1)).over(whole), 1).otherwise(0)
    return (placed
            .withColumn("_gap", gap)
            .withColumn("offset_ms", F.sum("_gap").over(upto))
            .withColumn("session_agent", F.coalesce(F.min(named).over(whole)["user_agent"], F.lit(DEFAULT_AGENT)))
            .withColumn("label", majority)
            .withColumn("traffic_class", F.when(F.col("label") == 0, "human").otherwise("scraper"))
            .withColumn("timestamp_ms", F.col("start_time_ms") + F.col("offset_ms"))
            .withColumn("request_id", F.col("row_no"))
            .drop("_gap", "_session"))


# Per label mean and deviation of gaps in ms, prefix of the addresses, and what is added to the seed.
SESSION_KINDS = {0: (2000.0, 800.0, "10.1", 0), 1: (500.0, 100.0, "10.2", 1)}


def numbered_by_label(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds row_no, 1-based within each label, by one numbering of all rows."""
    numbered = number_rows(rows, [F.col("label"), *order], "http")
    # one row per label
    firsts = numbered.groupBy("label").agg(F.min("row_no").alias("_first"))
    return numbered.join(F.broadcast(firsts), "label").withColumn("row_no", F.col("row_no") - F.col("_first") + 1).drop("_first")


def numbered_in_files(rows: DataFrame) -> DataFrame:
    """Adds row_no, 1-based within each label, to stored rows of files, in order of file and block number.

    A block number says where a row lies, so rows are counted in runs of block numbers and numbered inside their run:
    nothing is sorted as a whole, and the order needs no sample.
    """
    run = ["label", "file", "_run"]
    placed = rows.withColumn("_run", F.floor(F.col("block_no") / NUMBERED_TOGETHER))
    # one row per run
    before = Window.partitionBy("label").orderBy("file", "_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*run).agg(F.count(F.lit(1)).alias("_rows"))
    offsets = materialize(counts.select(*run, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")), "offsets")
    inside = F.row_number().over(Window.partitionBy(*run).orderBy("block_no"))
    return (placed.join(F.broadcast(offsets), run)
            .select("label", *[c for c in rows.columns if c != "label"], (inside + F.col("_before")).alias("row_no")))


def labelled_sessions(numbered: DataFrame, session_size: int, seed: int, caps: dict[int, int | None] | None = None) -> DataFrame:
    """Pseudo-sessions of rows numbered by label, each label with its own kind of sessions."""
    sides = []
    for label, (gap, std, prefix, more) in SESSION_KINDS.items():
        rows = cap_requests(numbered.filter(F.col("label") == label), (caps or {}).get(label), session_size)
        sides.append(pseudo_sessions(rows, session_size, gap, std, prefix, seed + more))
    return reduce(DataFrame.unionByName, sides)


def load_sessions(spark: SparkSession, folder: str, config: Settings = DEFAULT,
                  max_normal: int | None = None, max_anomalous: int | None = None,
                  shuffle: bool = False) -> DataFrame:
    """Labelled files to request rows with sessions, in file order or in a seeded order."""
    h = config.http_text
    # stored first: numbering reads the rows more than once, and text is parsed once
    loaded = materialize(load_labelled(spark, folder, config), "loaded")
    if shuffle:
        # by content: the folder of the files plays no part
        mixed = F.md5(F.concat_ws("|", "block_no", "method", "url", "user_agent", "body", F.lit(str(h.seed))).cast("binary"))
        numbered = numbered_by_label(loaded, [mixed, *[F.col(c) for c in BLOCK_ORDER]])
    else:
        numbered = numbered_in_files(loaded)
    return labelled_sessions(numbered, h.session_size, h.seed, {0: max_normal, 1: max_anomalous})


def render_blocks(requests: DataFrame) -> DataFrame:
    """Request rows to text blocks, one per row: the inverse of reading."""
    header = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    agent = F.concat(F.lit("User-Agent: "), "user_agent")
    line = F.concat_ws(" ", "method", "url", F.lit("HTTP/1.1"))
    return requests.withColumn("block", F.concat_ws(
        "\n", line, F.lit("Host: first"), header, agent, F.lit("Host: 127.0.0.1:8080")))
