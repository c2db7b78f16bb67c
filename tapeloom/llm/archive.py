"""WARC archives, written and read as a chunked record table.

Writing: a page is one WARC record; a payload of more than ``chunk`` characters is cut
into numbered chunks, which the format calls segments: the record, then continuation
records that name its id. Payloads are cut where they are read, in one pass that goes on
with a digest from chunk to chunk; from there on rows hold a chunk each, also where equal
payloads are found. Chunk rows go through Spark's text writer, whose separator is
the blank line pair that ends every WARC record, so archives are plain WARC files,
compressed whole, on any store, and a lost executor leaves no half archive.

Reading: a compressed archive is read by one task, line by line, and each record's
payload goes out as rows of record id and chunk number with a digest so far, so no whole
record is ever held; the last chunk's row has the length and digest of all of it.

Records with equal payloads of at least ``least`` bytes are kept once: the one with the
largest page_id is the response, the others revisit it and have no payload of their own.

Defined results: null html is an empty payload; null urls are left out; line ends in
urls are percent-encoded; pages without an id are records of their own that only ever
revisit; repeated rows with the largest page_id are all responses; an empty table makes
archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, scratch, small_batches, text_or_empty, tidy

CRLF, END = "\r\n", "\r\n\r\n"
CHUNK = 1 << 20
#: Characters of the chunks that go on from Python at a time.
HELD = 1 << 22
#: A page with the payload of many others is dealt to so many places.
SALTS = 32


def cut(pages: DataFrame, chunk: int = CHUNK, pieces: bool = True) -> DataFrame:
    """The chunked record table of pages: row (a number for each page), page_id, url, k, piece
    (text of the chunk), chunks and the payload's bytes and digest; without ``pieces`` the
    first chunk's row, bare."""
    small_batches(pages.sparkSession)

    def parts(text: str) -> Iterator[str]:
        return (text[a : a + chunk] for a in range(0, max(len(text), 1), chunk))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i in range(batch.num_rows):
                *page, text = (batch.column(c)[i].as_py() for c in range(4))
                sha, size, n = hashlib.sha1(), 0, 0
                for piece in parts(text):  # from chunk to chunk, never the whole payload in bytes
                    data = piece.encode()
                    sha.update(data)
                    size, n = size + len(data), n + 1
                told = n, size, base64.b32encode(sha.digest()).decode()
                for k, piece in enumerate(parts(text) if pieces else [None]):
                    rows.append((*page, k + 1, piece, *told))
                    held += len(piece or "")
                    if held >= HELD:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names = ["row", "page_id", "url", "k", "piece", "chunks", "payload_bytes", "payload_digest"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string()]
    source = pages.select(F.monotonically_increasing_id(), F.col("page_id").cast("long"), F.col("url").cast("string"), text_or_empty("html").alias("html"))
    return source.mapInArrow(tidy(run), "row long, page_id long, url string, k int, piece string, chunks int, payload_bytes long, payload_digest string")


def with_originals(pages: DataFrame, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """Rows of :func:`cut` with refers_to (null: a response); a revisit has one, without text.

    All chunks of a page stand together, in order: they come out of one task and go to one.
    """
    groups = cut(pages.withColumn("url", F.lit(None)), chunk, pieces=False).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    shared = groups.filter((F.col("n") > 1) & (F.col("payload_bytes") >= least) & F.col("original").isNotNull())
    salted = shared.select(
        F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"), "original", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    )
    rows = cut(pages, chunk).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    at = (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")) & (F.col("salt") == F.col("s"))
    joined = rows.join(salted, at, "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")))
    revisit = F.col("refers_to").isNotNull()
    joined = joined.filter(~revisit | (F.col("k") == 1))
    joined = joined.sortWithinPartitions("row", "k")
    return joined.withColumns({"piece": F.when(revisit, F.lit("")).otherwise(F.col("piece")), "chunks": F.when(revisit, F.lit(1)).otherwise(F.col("chunks"))})


def write(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = 0) -> None:
    """Write archives of ``pages`` (page_id, url, html) under ``path``."""
    rows, piece = with_originals(pages, chunk, least), F.col("piece")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit, first = F.col("refers_to").isNotNull(), F.col("k") == 1
    size = F.col("payload_bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(END))
    body = F.when(first, F.concat(http, piece)).otherwise(piece)

    def head(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))

    def only(when: Column, line: Column) -> Column:
        return F.when(when, line).otherwise(F.lit(""))

    kind = F.when(~first, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        head("WARC-Type", kind),
        head("WARC-Record-ID", F.when(first, urn(F.col("page_id"))).otherwise(F.concat(F.lit("<urn:part:"), F.uuid(), F.lit(">")))),
        head("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        only(url.isNotNull(), head("WARC-Target-URI", F.coalesce(url, F.lit("")))),
        only(first, head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        only(revisit, head("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        only(revisit, head("WARC-Refers-To", urn(F.col("refers_to")))),
        only(F.col("chunks") > 1, head("WARC-Segment-Number", F.col("k").cast("string"))),
        only(~first, head("WARC-Segment-Origin-ID", urn(F.col("page_id")))),
        only((F.col("chunks") > 1) & (F.col("k") == F.col("chunks")), head("WARC-Segment-Total-Length", (F.octet_length(http) + F.col("payload_bytes")).cast("string"))),
        only(first, head("Content-Type", F.lit("application/http; msgtype=response"))),
        head("Content-Length", F.octet_length(body).cast("string")),
        F.lit(CRLF),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class _Reader:
    """Takes an archive's lines one by one and gives chunk rows; holds one chunk at most."""

    def __init__(self, chunk: int):
        self.chunk = chunk
        self.page: dict = {}
        self._start()

    def _start(self) -> None:
        self.head: dict[str, str] = {}
        self.state, self.left = "version", 0

    def feed(self, line: bytes) -> Iterator[tuple]:
        """``line`` ends with its line feed."""
        at = 0
        while at < len(line):
            if self.state in ("version", "head", "gap", "http"):
                if self.state == "gap":
                    self.left -= len(line) - at
                    if not self.left:
                        yield from self._ended()
                elif self.state == "version":
                    if line[at:] != b"WARC/1.1\r\n":
                        raise ValueError(f"not a WARC record: {line[at : at + 40]!r}")
                    self.state = "head"
                elif line[at:] != b"\r\n":
                    name, _, value = line[at:].decode().partition(": ")
                    self.head[name.lower() if self.state == "head" else f"http-{name.lower()}"] = value.removesuffix(CRLF)
                    self.left -= (len(line) - at) * (self.state == "http")
                elif self.state == "head":
                    self.left = int(self.head["content-length"])
                    first = self.head["warc-type"] != "continuation"
                    if first:
                        self.page = {"sha": hashlib.sha1(), "bytes": 0, "n": 0, "held": bytearray(), "head": self.head}
                    self.state = "http" if first else "body" if self.left else "end"
                else:
                    self.left -= 2
                    self.state = "body" if self.left else "end"
                if self.state == "end":
                    self.state, self.left = "gap", 4
                return
            part = line[at : at + self.left]
            at, self.left = at + len(part), self.left - len(part)
            self.page["sha"].update(part)
            self.page["bytes"] += len(part)
            self.page["held"] += part
            while len(self.page["held"]) > self.chunk:
                yield self._row(bytes(self.page["held"][: self.chunk]), False)
                del self.page["held"][: self.chunk]
            if not self.left:
                self.state, self.left = "gap", 4

    def _ended(self) -> Iterator[tuple]:
        cut = "warc-segment-number" in self.head and "warc-segment-total-length" not in self.head
        if not cut:
            yield self._row(bytes(self.page["held"]), True)
        self._start()

    def _row(self, data: bytes, last: bool) -> tuple:
        p, head = self.page, self.page["head"]
        number = lambda urn: None if "none" in urn else int(urn[len("<urn:page:") : -1])
        digest, size, refers = base64.b32encode(p["sha"].digest()).decode(), p["bytes"], None
        said = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "revisit":
            digest, size, refers = said, int(head["http-content-length"]), number(head["warc-refers-to"])
        elif last and digest != said:
            raise ValueError(f"damaged payload in {head['warc-record-id']}")
        p["n"] += 1
        return number(head["warc-record-id"]), p["n"], last, data, size, digest, head["warc-type"], refers, head.get("warc-target-uri")


def read(spark: SparkSession, path: str, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """The chunked record table of archives.

    page_id, chunk_no, last, payload (of the chunk), payload_bytes and payload_digest (up to
    and with this chunk; of the full payload in the last), record_type, refers_to, url.
    """
    small_batches(spark)
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk)
        for batch in batches:
            rows = [r for line in batch.column(0).to_pylist() for r in reader.feed(line.encode() + b"\n")]
            if not with_payload:
                rows = [(*r[:3], None, *r[4:]) for r in rows]
            if rows:
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = ["page_id", "chunk_no", "last", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    types = [pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    kinds = "page_id long, chunk_no int, last boolean, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    return lines.mapInArrow(run, kinds)


def round_trip(pages: DataFrame, path: str | None = None, chunk: int = CHUNK, least: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back, and describe each record.

    Without a ``path`` the archives are only there in between.
    """
    with Workspace(pages.sparkSession) as work:
        files = path or work.own(scratch(pages.sparkSession, "warc"))
        write(pages, files, chunk, least)
        whole = read(pages.sparkSession, files, chunk, with_payload=False).filter("last")
        return work.keep(whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


def sql(least: int = 0) -> str:
    """DuckDB SQL for the rows of :func:`round_trip`."""
    groups = " || ".join(
        f"array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, {1 + 10 * i}, 10) AS BIGINT) >> (35 - 5 * j)) & 31 AS INTEGER) + 1, 1) FOR j IN range(8)], '')"
        for i in range(4)
    )
    return f"""
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS original, count(*) OVER (PARTITION BY h, payload_bytes) AS n FROM p),
        r AS (SELECT *, CASE WHEN n > 1 AND payload_bytes >= {least} AND page_id IS DISTINCT FROM original THEN original END AS refers_to FROM o)
        SELECT page_id, payload_bytes, {groups} AS payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""
