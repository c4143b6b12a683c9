"""WARC archives: writing, reading, and resolving captures of the same payload into revisit records.

Headers are shuffled by payload digest; of captures with one payload the smallest id stays a
response and the others become revisit records that refer to it. The deduplicated archive is
written with fresh headers by Spark's text sink: a WARC file is its records, each ended by two line
breaks, which is the sink's line separator. Files are committed by Spark, so a lost executor leaves
no half-written archive. Reading is a stream, too: the text source cuts a file at every line feed,
and a parser puts records together again by their lengths, one at a time. A separator of one byte
can't overlap with a payload's last bytes, and every file ends in one, so the pieces with a line feed
behind each are the file. Every response's digest is computed anew from its payload and revisits are
joined to the originals by digest.

Cases: a null payload is empty; a null url leaves out the target header; line breaks in a url are
percent-encoded; a null id is written as `null` and sorts last; rows that repeat the id and payload
of the response are responses too; payloads shorter than min_bytes are never revisits; an empty
table gives an empty archive and result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.common import bounded, cut, new_path, table

#: Records in one file at most. Files are read as streams, so their size bounds no memory.
RECORDS_PER_FILE = 1_000
#: Payloads that several records have are broadcast by digest (about 60 bytes each) up to this count; beyond it they are joined.
BROADCAST_GROUPS = 200_000
#: Fixed value: what ends a record, and a head. Its last byte is where files are cut for reading.
BREAKS = b"\r\n\r\n"

#: Digits of base 32 as Spark's conv() writes them, and as RFC 4648 does.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_ID = "urn:geoloom:page:"
READ_SCHEMA = "id string, record_type string, digest string, bytes long, refers_to string, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1. 160 bits are 60, 60 and 40 bits: 12, 12 and 8 digits."""
    hexed = F.sha1(payload)
    parts = [(1, 15, 12), (16, 15, 12), (31, 10, 8)]
    digits = [F.lpad(F.conv(F.substring(hexed, a, n), 16, 32), d, "0") for a, n, d in parts]
    return F.translate(F.concat(*digits), CONV_DIGITS, BASE32_DIGITS)


def mark_revisits(records: DataFrame, min_bytes: int = 0, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """id, url and payload (binary) of records with digest, bytes, and `original`: the id of the response with the same payload."""
    records = records.select("id", "url", "payload").withColumns({"digest": base32_sha1(F.col("payload")), "bytes": F.octet_length("payload").cast("long")})
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"))).alias("first")
    # Only headers are aggregated, with one row per digest and task before the shuffle. Payloads that stand once need no join.
    groups = records.groupBy("digest", "bytes").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "bytes", F.col("first.id").alias("original"), F.lit(True).alias("shared"))
    groups, _ = cut(groups, "originals")
    groups = F.broadcast(groups) if groups.count() <= broadcast_groups else groups
    marked = records.join(groups, ["digest", "bytes"], "left").withColumn("original", F.when(F.col("shared"), F.col("original")).otherwise(F.col("id"))).drop("shared")
    return marked.withColumn("revisit", (F.col("bytes") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("original")))


def _name(id_: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit(">"))


def render_records(marked: DataFrame, date: str) -> DataFrame:
    """One string `value` per record, without the two line breaks that end it."""
    eol = F.lit("\r\n")
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload").cast("string"))
    size = F.octet_length(http) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), eol,
        F.lit("WARC-Record-ID: "), _name(F.col("id")), eol, F.lit(f"WARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, eol), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), eol,
        F.when(F.col("revisit"), F.concat(
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            _name(F.col("original")), eol)).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), size.cast("string"), eol, eol,
    )
    return marked.select(F.concat(header, http, body).alias("value"))


def write_warc(marked: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes gzip-compressed WARC files under path."""
    (render_records(marked, date).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse_warc(chunks):
    """Yields (headers with lower-case names, block) of each record of a stream; holds one record and one chunk."""
    data, chunks = bytearray(), iter(chunks)

    def filled(until) -> bool:
        """Reads on until `until` holds; false at the end of the stream."""
        while not until():
            more = next(chunks, None)
            if more is None:
                return False
            data.extend(more)
        return True

    while filled(lambda: data):
        if not filled(lambda: BREAKS in data):
            raise ValueError("a WARC record without an end of its head")
        end = data.index(BREAKS)
        lines = data[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should begin: {lines[0][:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + len(BREAKS), int(headers["content-length"])
        if not filled(lambda: len(data) >= start + size + len(BREAKS)):
            raise ValueError("a WARC record is cut off")
        yield headers, bytes(data[start : start + size])
        del data[: start + size + len(BREAKS)]


def _chunks(batches):
    """The files' bytes: their lines with the line feeds put back, some hundred at a time."""
    for batch in batches:
        lines = batch.column(0)
        for begin in range(0, len(lines), 256):
            yield b"\n".join([*lines.slice(begin, 256).to_pylist(), b""])


def _read_files(batches):
    schema = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("bytes", pa.int64()), ("refers_to", pa.string()), ("intact", pa.bool_())])
    name = lambda x: None if (x := x[len(RECORD_ID) + 1 : -1]) == "null" else x
    rows = []

    def made():
        out = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
        rows.clear()
        return out

    for headers, block in parse_warc(_chunks(batches)):
        kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
        payload = block[block.index(BREAKS) + len(BREAKS) :]
        whole = kind == "response"
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else said
        to = headers.get("warc-refers-to")
        rows.append((name(headers["warc-record-id"]), kind, found, len(payload) if whole else None, name(to) if to else None, found == said))
        if len(rows) == 1024:
            yield made()
    if rows:
        yield made()


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: id, record_type, digest (of a response: of its payload as read), bytes, refers_to, intact."""
    pieces = spark.read.option("lineSep", "\n").option("pathGlobFilter", "part-*").text(path)
    return bounded(pieces).select(F.col("value").cast("binary")).mapInArrow(_read_files, READ_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """records with `bytes` of revisits taken from the original response of the same digest."""
    originals = (records.filter("record_type = 'response'").groupBy("digest").agg(F.max("bytes").alias("original_bytes")))
    return records.join(originals, "digest", "left").withColumn("bytes", F.coalesce("bytes", "original_bytes")).drop("original_bytes")


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    records = pages.select(F.col("page_id").alias("id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    path = new_path(spark, "warc")
    write_warc(mark_revisits(records), path)
    read = resolve_revisits(read_warc(spark, path))
    return read.select(
        F.col("id").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )


QUERIES = {"op1_warc_revisit": op1_warc_revisit}

ORACLE_SQL = {
    "op1_warc_revisit": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS x, min(page_id) OVER (PARTITION BY payload) AS o FROM p),
b AS (SELECT *, [('0x' || substr(x, 5 * k + 1, 5))::BIGINT FOR k IN range(8)] AS q FROM h)
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((q[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = o THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> o THEN o END AS refers_to FROM b
"""
}
