"""WARC archives written from and read back into a table of chunks.

Pages are cut into chunks where they are read (:func:`chunked`): one row per record and chunk number, with the digests and
the length of the payload so far, so the last chunk's are those of the whole. Records with equal payloads (length, SHA-1
and SHA-256) are found by the last chunks alone: the one with the largest page_id is the response, the others revisit it.

:func:`write_archives` turns every chunk into a WARC record of its own: a response, or its first segment, then
``continuation`` segments (WARC-Segment-Number, -Origin-ID, -Total-Length). Spark's text writer lays them out, one row a
record and the blank lines after a record as line separator; the files are compressed, so a file is read from its start.
:func:`read_archives` parses the files as streams by Content-Length and gives the chunk table again, with digests carried from chunk
to chunk. A payload of any length passes through in pieces of ``CHUNK`` bytes; no record is put together in memory.

A null or empty html is an empty payload, a null page_id is the smallest, a null url gives no target; line breaks in urls are escaped.
Repeated rows are records of their own: one responds, the others revisit. Columns other than page_id, url and html are left
out. An empty table gives archives without records, which read as an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.llm.common import shared_folder, written
from eventlink.operators.joins import attach

#: Bytes of payload in a chunk.
CHUNK = 1 << 20
#: Bytes of payload in a batch handed on.
BATCH = 1 << 22
# Line ends of the format, and the date every record bears, as the pages have none.
LINE = b"\r\n"
BLANK = b"\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

CHUNKS = "record long, page_id long, url string, chunk long, payload binary, n_bytes long, sha1 string, sha256 string, last boolean"
READ = (
    "record_id string, page_id long, url string, record_type string, refers_to_id string, refers_to long, chunk long, payload binary, "
    "n_bytes long, sha1 string, declared string, last boolean"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


class Running:
    """Length and digests of a payload that comes in pieces."""

    def __init__(self):
        self.size, self.sha1, self.sha256 = 0, hashlib.sha1(), hashlib.sha256()

    def add(self, piece: bytes) -> None:
        self.size += len(piece)
        self.sha1.update(piece)
        self.sha256.update(piece)


class Rows:
    """Rows of a schema, handed on when their payloads reach ``BATCH`` bytes."""

    def __init__(self, schema: str):
        fields = [f.split() for f in schema.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
        self.schema = pa.schema([(name, kinds[kind]) for name, kind in fields])
        self.rows, self.size = [], 0

    def add(self, payload: bytes | None, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += 512 + len(payload or b"")
        if self.size >= BATCH:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)]
            self.rows, self.size = [], 0
            yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


def chunked(pages: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of ``pages`` (page_id, url, html): see ``CHUNKS``. A payload has one chunk at least."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(CHUNKS)
        for batch in batches:
            record, page_id, url, html = batch.columns
            for k in range(batch.num_rows):
                payload = memoryview(html[k].as_buffer())
                key = (record[k].as_py(), page_id[k].as_py(), url[k].as_py())
                seen = Running()
                for number, at in enumerate(range(0, max(len(payload), 1), size)):
                    piece = bytes(payload[at : at + size])
                    seen.add(piece)
                    last = at + size >= len(payload)
                    yield from rows.add(piece, *key, number, piece, seen.size, base32(seen.sha1.digest()), seen.sha256.hexdigest(), last)
        yield from rows.rest()

    payload = F.coalesce("html", F.lit("")).cast("binary").alias("html")
    numbered = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), F.col("url").cast("string"), payload)
    return numbered.mapInArrow(cut, CHUNKS)


def roles(chunks: DataFrame) -> DataFrame:
    """Per record: its whole length and digest, whether it responds, and the record and page that respond for it."""
    whole = chunks.where("last").select("record", "page_id", "n_bytes", "sha1", "sha256")
    best = whole.groupBy("n_bytes", "sha1", "sha256").agg(F.max(F.struct("page_id", "record")).alias("best"))
    best = best.select(*[F.col(c).alias(f"_{c}") for c in ("n_bytes", "sha1", "sha256")], "best")
    known = attach(whole, best, [(F.col(c), f"_{c}") for c in ("n_bytes", "sha1", "sha256")], "inner")
    return known.select(
        "record",
        F.col("n_bytes").alias("total"),
        F.col("sha1").alias("digest"),
        (F.col("best.record") == F.col("record")).alias("responds"),
        F.col("best.record").alias("origin"),
        F.col("best.page_id").alias("origin_page"),
    )


def record_id(record: Column, chunk: Column) -> Column:
    """A name-based identifier of a record or segment."""
    h = F.md5(F.concat_ws("/", record.cast("string"), chunk.cast("string")))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(chunks: DataFrame, size: int = CHUNK) -> DataFrame:
    """``value``: a WARC record without the blank lines after it, for every chunk of a response and for every revisit.

    Chunks are dealt by record once; that serves the join, and keeps a record's chunks in one task and so in one file.
    """
    rows = chunks.repartition("record").join(roles(chunks), "record").where("responds OR chunk = 0")
    first, cut = F.col("chunk") == 0, F.col("total") > size
    kind = F.when(~F.col("responds"), "revisit").when(first, "response").otherwise("continuation")
    http = F.when(first, HTTP).otherwise("")
    payload = F.when(F.col("responds"), F.col("payload")).otherwise(F.lit(b""))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    none, revisit, segment = F.lit(None), ~F.col("responds"), F.col("responds") & cut
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_id(F.col("record"), F.col("chunk"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest")).otherwise(none)),
        line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest").otherwise(none)),
        line("WARC-Refers-To", F.when(revisit, record_id(F.col("origin"), F.lit(0))).otherwise(none)),
        line("WARC-Segment-Number", F.when(segment, F.col("chunk") + 1).otherwise(none)),
        line("WARC-Segment-Origin-ID", F.when(segment & ~first, record_id(F.col("record"), F.lit(0))).otherwise(none)),
        line("WARC-Segment-Total-Length", F.when(segment & F.col("last"), F.col("total") + len(HTTP)).otherwise(none)),
        line("Page-Id", F.col("page_id")),
        line("Refers-To-Page-Id", F.when(revisit, F.col("origin_page")).otherwise(none)),
        line("Content-Type", F.when(first, "application/http;msgtype=response").otherwise(none)),
        line("Content-Length", F.octet_length(http) + F.octet_length(payload)),
        F.lit("\r\n"),
        http,
    )
    value = F.concat(F.encode(header, "UTF-8"), payload).cast("string")
    return rows.select("record", "chunk", value.alias("value"))


def write_archives(pages: DataFrame, folder: str, size: int = CHUNK) -> None:
    """Archives of ``pages``, gzipped; the segments of a record follow one another in one file."""
    chunks = written(chunked(pages, size))
    ordered = records(chunks, size).sortWithinPartitions("record", "chunk")
    ordered.select("value").write.option("compression", "gzip").option("lineSep", BLANK.decode()).text(folder)


class Parser:
    """WARC records out of a stream of bytes, as rows of ``READ``; it holds a header, or one piece of a payload."""

    def __init__(self, size: int):
        self.size, self.waiting = size, bytearray()
        self.header: dict[str, str] | None = None
        self.left = 0  # bytes of the block that are still to come
        self.origin: dict[str, str] = {}
        self.seen, self.chunk, self.http = Running(), 0, False

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.waiting += data
        while True:
            if self.header is None:
                while self.waiting[:2] == LINE:
                    del self.waiting[:2]
                end = self.waiting.find(BLANK)
                if end < 0:
                    return
                self._open(bytes(self.waiting[:end]).decode())
                del self.waiting[: end + 4]
            elif self.http:
                end = self.waiting.find(BLANK)
                if end < 0:
                    return
                del self.waiting[: end + 4]
                self.left -= end + 4
                self.http = False
            elif len(self.waiting) >= min(self.left, self.size):
                n = min(self.left, self.size)
                piece = bytes(self.waiting[:n])
                del self.waiting[:n]
                self.left -= n
                yield self._row(piece)
                if not self.left:
                    self.header = None
            else:
                return

    def _open(self, header: str) -> None:
        """Take in a header; a record that is no continuation starts a payload of its own."""
        version, *lines = header.split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC header: {version[:80]!r}")
        self.header = dict(text.split(": ", 1) for text in lines)
        self.left = int(self.header["Content-Length"])
        self.http = self.header["WARC-Type"] != "continuation"
        if self.http:
            self.origin, self.seen, self.chunk = self.header, Running(), 0

    def _row(self, piece: bytes) -> tuple:
        self.seen.add(piece)
        at, here = self.origin, self.header
        segmented = "WARC-Segment-Number" in at
        last = not self.left and (not segmented or "WARC-Segment-Total-Length" in here)
        page, other = at.get("Page-Id"), at.get("Refers-To-Page-Id")
        row = (
            at["WARC-Record-ID"],
            None if page is None else int(page),
            at.get("WARC-Target-URI"),
            at["WARC-Type"],
            at.get("WARC-Refers-To"),
            None if other is None else int(other),
            self.chunk,
            piece,
            self.seen.size,
            base32(self.seen.sha1.digest()),
            at["WARC-Payload-Digest"].removeprefix("sha1:"),
            last,
        )
        if last and at["WARC-Type"] == "response" and row[9] != row[10]:
            raise ValueError(f"the payload of {row[0]} does not have its digest")
        self.chunk += 1
        return row

    def close(self) -> None:
        if self.header is not None or self.waiting.strip(LINE):
            raise ValueError("an archive ends within a record")


def read_archives(spark: SparkSession, folder: str, size: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunk table of the archives in a folder: see ``READ``. Without ``payloads`` only the last chunk of each record, payload null."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parser, file = Rows(READ), Parser(size), None
        for batch in batches:
            for name, value in zip(batch.column(0), batch.column(1), strict=True):
                if name.as_py() != file:
                    parser.close()
                    parser, file = Parser(size), name.as_py()
                for row in parser.feed(value.as_py() + BLANK):
                    if payloads:
                        yield from rows.add(row[7], *row)
                    elif row[-1]:
                        yield from rows.add(None, *row[:7], None, *row[8:])
        parser.close()
        yield from rows.rest()

    lines = spark.read.option("lineSep", BLANK.decode()).option("pathGlobFilter", "*.gz").text(folder)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(parse, READ)


def resolved(rows: DataFrame) -> DataFrame:
    """Last chunks as one row per record; a revisit gets the length and digest measured at the record it refers to."""
    ends = written(rows.where("last").select("record_id", "page_id", "record_type", "refers_to_id", "refers_to", "n_bytes", "sha1"))
    responses = ends.where("record_type = 'response'")
    target = responses.select(F.col("record_id").alias("_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"))
    revisits = attach(ends.where("record_type = 'revisit'"), target, [(F.col("refers_to_id"), "_id")])
    own = responses.withColumns({"payload_bytes": F.col("n_bytes"), "payload_digest": F.col("sha1")})
    return own.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written as archives into the shared folder and read back."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    write_archives(pages, folder)
    return resolved(read_archives(spark, folder, payloads=False))


#: Rows of the query.
SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) = 1 AS responds,
        max(page_id) OVER (PARTITION BY payload) AS largest
    FROM payloads
)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(h, 1 + (i // 4 * 5)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN responds THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT responds THEN largest END AS refers_to
FROM ranked
"""
