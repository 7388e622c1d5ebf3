"""WARC archives whose repeated payloads are revisit records.

Writing: payload digests of narrow header rows are shuffled, every group of equal payloads names its
original, and the records go out through Spark's text sink with the record end as line separator, so
task commits make the archives safe against lost executors. Reading: files are read as pieces between
blank lines and put together again by Content-Length, so payloads may hold anything; revisit records
are then joined to the responses they refer to.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficlens.llm.hot import join_counted
from trafficlens.llm.text import row_key, whole
from trafficlens.operators.skew import materialize, new_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = "\r\n\r\n"
LINE = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = "record_type string, record_id string, refers_to_id string, page_id bigint, payload_bytes bigint, payload_digest string, target_uri string"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: 32 digits of 5 bits."""
    digits = []
    for part in range(4):
        value = F.conv(F.substring(F.sha1(payload), 1 + 10 * part, 10), 16, 10).cast("bigint")
        digits += [F.substring(F.lit(BASE32), F.shiftright(value, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for k in range(8)]
    return F.concat(*digits)


def record_id(page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws(" ", F.coalesce(page_id.cast("string"), F.lit("")), digest).cast("binary"))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _uri(url: Column) -> Column:
    """White space and control characters would break the header."""
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def resolve(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """_id, _text, digest, original: one row per distinct (page_id, html); original is the smallest page_id of
    an equal payload where the page is to be a revisit, else null."""
    html = whole("html")
    headers = materialize(pages.select("page_id", *row_key(F.col("page_id"), html), F.octet_length(html).alias("_bytes"),
                                       base32_sha1(html).alias("digest")).distinct(), "headers")
    large = headers.filter(F.col("_bytes") >= min_bytes)
    # payloads that very many pages share (empty ones) are joined on the map side
    originals = large.groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    found = join_counted(headers, materialize(originals, "originals"), "digest", "_rows")
    revisits = (F.col("_bytes") >= min_bytes) & F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return found.select("_id", "_text", "digest", F.when(revisits, F.col("_first")).alias("_original"))


def records(pages: DataFrame, date: str, min_bytes: int = 0) -> DataFrame:
    """One column `record`: header, blank line and block of every page, without the end of the record."""
    html = whole("html")
    keyed = pages.select("page_id", "url", html.alias("_html"), *row_key(F.col("page_id"), html))
    rows = keyed.join(resolve(pages, min_bytes), ["_id", "_text"])
    is_revisit = F.col("_original").isNotNull()

    def field(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    size = F.octet_length("_html").cast("string")
    http = F.concat_ws(LINE, F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), size))
    block = F.when(is_revisit, F.concat(http, F.lit(END))).otherwise(F.concat(http, F.lit(END), F.col("_html")))
    header = F.concat_ws(
        LINE, F.lit("WARC/1.1"), field("WARC-Type", F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id(F.col("page_id"), F.col("digest"))), F.lit(f"WARC-Date: {date}"),
        field("WARC-Target-URI", _uri(F.col("url"))), field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(is_revisit, field("WARC-Refers-To", record_id(F.col("_original"), F.col("digest")))),
        field("Page-Id", F.col("page_id").cast("string")), F.lit("Content-Type: application/http; msgtype=response"),
        field("Content-Length", F.octet_length("_block").cast("string")))
    return rows.withColumn("_block", block).select(F.concat(header, F.lit(END), F.col("_block")).alias("record"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str | None = None) -> None:
    """Gzipped archives under the path, one per partition. `date` goes into all fresh headers."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records(pages, date, min_bytes).write.option("lineSep", END).option("compression", "gzip").text(path)


def _parse(record: bytes, block: bytes) -> tuple:
    fields = {}
    for line in record.split(b"\r\n")[1:]:
        name, _, value = line.partition(b": ")
        fields[name.decode().lower()] = value.decode()
    payload = block.partition(b"\r\n\r\n")[2]
    kind, named = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        computed = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if computed != named:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    page = fields.get("page-id")
    return (kind, fields["warc-record-id"], fields.get("warc-refers-to"), None if page is None else int(page),
            len(payload) if kind == "response" else None, named, fields.get("warc-target-uri"))


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header rows of the records in a stream of pieces between blank lines. A gzipped file is never split."""
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("target_uri", pa.string())])
    end = END.encode()
    header, parts, have, need = b"", [], 0, 0
    for batch in batches:
        rows = []
        for piece in batch.column(0).cast(pa.binary()):
            # the bytes of the file again: a piece and the blank line that ended it
            data = piece.as_py() + end
            while data:
                if not parts and not header:
                    # a payload that ends in line breaks shifts the last separator: what is left of it is no record
                    if not data.strip(b"\r\n"):
                        break
                    header, data = data[:data.index(end)], data[data.index(end) + len(end):]
                    need = int(header.rpartition(b"Content-Length: ")[2]) + len(end)
                    have = 0
                taken, data = data[:need - have], data[need - have:]
                parts.append(taken)
                have += len(taken)
                if have == need:
                    rows.append(_parse(header, b"".join(parts)[:-len(end)]))
                    header, parts = b"", []
        columns = list(zip(*rows)) if rows else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
    if header:
        raise ValueError("the archive ends inside a record")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Header fields of all records of the archives; payloads are checked against their digests."""
    return spark.read.option("lineSep", END).text(path).mapInArrow(_records_of, HEADERS)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to; revisits take
    size and page from the response that they refer to."""
    headers = materialize(read_headers(spark, path), "warc-headers")
    # only revisits look for a response; a response that very many refer to is joined on the map side
    is_response = F.col("record_type") == "response"
    revisits = headers.filter(~is_response)
    asked = revisits.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("_rows"))
    responses = (headers.filter(is_response).groupBy(F.col("record_id").alias("refers_to_id"))
                 .agg(F.min("page_id").alias("_page"), F.min("payload_bytes").alias("_bytes")).join(asked, "refers_to_id"))
    named = join_counted(revisits, materialize(responses, "responses"), "refers_to_id", "_rows")
    own = headers.filter(is_response).withColumns({"_page": F.lit(None).cast("bigint"), "_bytes": F.lit(None).cast("bigint")})
    found = own.unionByName(named)
    return found.select("page_id", F.coalesce("payload_bytes", "_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                        F.col("_page").alias("refers_to"), "target_uri")


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write the pages, read the archives back: one row per page.

    Null html is an empty payload; a null url is left out of the header. Of equal payloads the smallest page_id
    is the response; pages with a null id revisit it, and are responses if no page of the group has an id. Rows that
    repeat the smallest id and its payload are all responses, under one record id. Payloads count whole, however long; an empty
    table gives no archive record and an empty table. Other columns are ignored.
    """
    path = path or new_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    return read_archives(pages.sparkSession, path)


WARC_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as h from pages),
d as (select *, sha1(h) as hex, min(page_id) over (partition by h) as first_id from p),
v as (select *, [cast('0x' || substr(hex, 1 + 10 * j, 10) as bigint) for j in range(4)] as parts from d)
select page_id, strlen(h) as payload_bytes,
       list_aggregate([substr('{BASE32}', 1 + ((parts[1 + i // 8] >> (35 - 5 * (i % 8))) & 31), 1) for i in range(32)], 'string_agg', '') as payload_digest,
       case when page_id = first_id or first_id is null then 'response' else 'revisit' end as record_type,
       case when page_id = first_id or first_id is null then null else first_id end as refers_to,
       regexp_replace(url, '[\\x00-\\x20\\x7F]', '%20', 'g') as target_uri
from v
"""
