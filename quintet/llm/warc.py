"""WARC archives of web pages: a writer with one gzip member for each record, and a sequential reader.

The reader inflates one member at a time in pieces, frames blocks by their
Content-Length and verifies block and payload digests. Records with equal
payloads are written once as response; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quintet.llm.common import new_dir, put_file, by_bytes

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16
#: Compressed input that one archive holds, about.
FILE_BYTES = 8 << 20


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def encode_record(kind: str, headers: list[tuple[str, str]], block: bytes, level: int = 6) -> bytes:
    """One gzip member with one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Length", str(len(block)))])
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + deflate.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, level: int = 6) -> bytes:
    """A response with the payload, or a revisit without it. Control characters of a URL are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is None:
        return encode_record("response", headers, http + payload, level)
    return encode_record("revisit", [*headers, ("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)], http, level)


@dataclass
class Record:
    kind: str
    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        """HTTP headers by lower-case name, and what follows them."""
        head, _, body = self.block.partition(b"\r\n\r\n")
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}, body


class _Inflate:
    """Bytes of the gzip members of a stream, one after another, inflated in pieces; other streams as they are."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.raw, self.out = read, read(PIECE), bytearray()
        self.zipped = self.raw[:2] == b"\x1f\x8b"
        self.member = zlib.decompressobj(31) if self.zipped else None

    def more(self) -> bool:
        """Inflate another piece; False at the end of the stream."""
        if not self.raw:
            self.raw = self.read(PIECE)
        if not self.raw:
            if self.zipped and not self.member.eof and self.started:
                raise ValueError("the archive ends inside a gzip member")
            return False
        if not self.zipped:
            self.out += self.raw
            self.raw = b""
            return True
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        self.started = True
        self.out += self.member.decompress(self.raw, PIECE)
        self.raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        if self.member.eof:
            self.started = False
        return True

    started = False

    def until(self, mark: bytes) -> bytes | None:
        """Up to and without ``mark``; None at the end of the stream."""
        at = 0
        while (found := self.out.find(mark, at)) < 0:
            at = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                if self.out.strip():
                    raise ValueError("the archive ends inside a header")
                return None
        got = bytes(self.out[:found])
        del self.out[: found + len(mark)]
        return got

    def exactly(self, n: int) -> bytes:
        while len(self.out) < n:
            if not self.more():
                raise ValueError("the archive ends inside a record")
        got = bytes(self.out[:n])
        del self.out[:n]
        return got


    def at_edge(self) -> bool:
        """Whether a gzip member ends here."""
        while self.zipped and not self.out and not self.member.eof and self.more():
            pass
        return not self.out and (not self.zipped or self.member.eof)


def read_records(read: Callable[[int], bytes], verify: bool = True, one_each: bool = False) -> Iterator[Record]:
    """The records of a stream, in order; ``read(n)`` gives its next n bytes or fewer. Raises ValueError for damage.

    With ``one_each`` a record must end its gzip member, as in archives that are read from any record on.
    """
    stream = _Inflate(read)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        record = Record(headers["warc-type"], headers, stream.exactly(int(headers["content-length"])))
        if stream.exactly(4) != b"\r\n\r\n":
            raise ValueError("a block is longer than its Content-Length")
        if one_each and not stream.at_edge():
            raise ValueError("a gzip member has more than a record")
        if verify and headers.get("warc-block-digest", said := f"sha1:{sha1(record.block)}") != said:
            raise ValueError("block digest differs")
        if verify and record.kind == "response" and headers.get("warc-payload-digest", said := f"sha1:{sha1(record.http[1])}") != said:
            raise ValueError("payload digest differs")
        yield record


def write_pages(pages: DataFrame, least_bytes: int = 0, level: int = 4, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None) -> str:
    """Write a record for every page to ``*.warc.gz`` files in a new folder of the shared store; returns the folder.

    Of pages with equal payloads (UTF-8 of the HTML, null: empty) of at least
    ``least_bytes`` bytes, those with the smallest id are responses, all others
    revisit it. A null id is larger than any; pages with null ids only are
    responses. Digests and ids alone are grouped; pages then take the
    id by a join on the digest, which Spark splits where a payload is hot.
    """
    spark = pages.sparkSession
    folder = folder or new_dir(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("key", F.when(F.length("payload") >= least_bytes, F.col("digest")))
    first = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("key is not null and n > 1").select("key", "first")
    rows = rows.join(first, "key", "left").select("page_id", "url", "payload", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, n, held = TaskContext.get().partitionId(), 0, 0, bytearray()
        info = encode_record("warcinfo", [("WARC-Record-ID", "<urn:quintet:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", level)
        for b in by_bytes(batches):
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held += (b"" if held else info) + page_record(page_id, url, payload, refers_to, level)
                n += 1
                if len(held) >= FILE_BYTES:
                    put_file(folder, f"pages-{part:06d}-{k:04d}.warc.gz", held)
                    k, held = k + 1, bytearray()
        if held:
            put_file(folder, f"pages-{part:06d}-{k:04d}.warc.gz", held)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    if not rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0]:
        put_file(folder, "pages-none.warc.gz", encode_record("warcinfo", [("WARC-Record-ID", "<urn:quintet:info>"), ("WARC-Date", DATE)], b""))
    return folder


def read_pages(spark, folder: str) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)`` of the archives of a folder.

    A row for each response or revisit, repeated ids too; a null id is null, a record without a URL has none. A revisit
    has no payload, but its size and digest. Archives without such records give none. Spark hands an archive, of about ``FILE_BYTES`` compressed or one
    record, over whole; the reader inflates it piece by piece. Raises ValueError for damage.
    """
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out, size = [], 0
                for r in read_records(pa.BufferReader(content.as_buffer()).read, one_each=True):
                    if r.kind not in ("response", "revisit"):
                        continue
                    http, body = r.http
                    whole = len(body) if r.kind == "response" else int(http["content-length"])
                    out.append((_page(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), body if r.kind == "response" else None, whole, r.headers["warc-payload-digest"].removeprefix("sha1:"), r.kind, _page(r.headers.get("warc-refers-to"))))
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds.types, strict=True)], schema=kinds)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("content")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: Every 5 of the 40 hex digits are 4 base32 digits.
_B32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST(('0x' || substr(h, {1 + 5 * i}, 5)) AS BIGINT) >> {s}) & 31 AS INTEGER) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
WARC_SQL = f"""
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
"""
