"""WARC archives: a writer with revisit records, and a salvage reader that gets past damage.

Writer. One record per row, each a gzip member of its own. Rows whose payloads are alike (SHA-256, of at least
``least`` bytes) share one ``response`` record, that of the smallest page id; the others become ``revisit`` records
without payload that name it. Members are written by Spark's text sink, whose commit protocol makes lost and repeated
tasks harmless: every member is made to end in a zero byte (an empty member is added where the last byte of the
length field is not zero), rows go out without that byte, and the sink's line separator is that byte.

Salvage reader. Records are read one after another, from gzip members or plain text. Each must pass its checks: the
member's CRC, a version line, a header of named fields, a block of Content-Length bytes, the closing two line
ends, and the block and payload digests where they are stated. After a failed check the reader searches for the next
gzip member or version line at which a record passes, goes on from there, and logs the bytes in between as
a quarantined gap with the reason. Zero bytes and line ends between records are padding, not gaps. A record that is
whole but lies inside the payload of a damaged one is recovered as a record: nothing tells it from a real one.

An archive is one row for Spark's binary reader, so an executor must hold the largest archive; the writer's archives are
as large as the writing tasks' shares of the input.

Defined results: a null text is an empty payload; a null url is written as ``about:blank``; a null page id is left out of
the record and of the search for the smallest; rows that share the smallest page id are all responses; repeated
rows are records each; an empty table gives no records; a response whose block is gone leaves its revisits with the
digest and no length; extra columns are not carried.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apflow.operators.joins import materialize

LEAST_SHARED = 100
DATE = "2024-01-01T00:00:00Z"
# fixed values of the WARC 1.1 format
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
MEMBER_HEAD = b"\x1f\x8b\x08"
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
PAGE_FIELD = "X-Page-Id"
HEADER_LIMIT = 1 << 20
FEED = 1 << 14  # bytes given to the decompressor at a time
BATCH_BYTES = 1 << 22


# --------------------------------------------------------------- writing
def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest())}>"


def _one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = [*fields, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", str(len(block)))]
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in lines)
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A ``response`` with an HTTP message of the payload, or a ``revisit`` with the message's head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", DATE), ("WARC-Target-URI", _one_line(url or "about:blank")),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if page_id is not None:
        fields.append((PAGE_FIELD, str(page_id)))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
        return record(fields, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    return record(fields, http + payload)


def member(data: bytes) -> bytes:
    """``data`` as a gzip member that ends in a zero byte (with an empty member after it, where it takes one)."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + EMPTY_MEMBER


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = LEAST_SHARED
) -> None:
    """Write the records of all rows as a folder of archives."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("body"),
    ).withColumn("digest", F.sha2("body", 256))
    shared = F.octet_length("body") >= least
    # only payloads that occur more than once; written, so that a hot payload's join can be split
    first = materialize(
        rows.where(shared).groupBy(F.col("digest").alias("same")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1").drop("n"))
    told = rows.join(first, (F.col("digest") == F.col("same")) & shared, "left")
    revisit = F.coalesce(~F.col("first_id").eqNullSafe(F.col("page_id")) & F.col("first_id").isNotNull(), F.lit(False))
    told = told.select("page_id", "url", "digest", "first_id", revisit.alias("revisit"), F.when(~revisit, F.col("body")).alias("body"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "body", "digest", "first_id", "revisit")]
            held, size = [], 0
            for i in range(batch.num_rows):
                page_id, url, body, digest, first_id, again = (c[i].as_py() for c in columns)
                held.append(member(page_record(page_id, url, body or b"", digest, first_id, again))[:-1])
                size += len(held[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["member"])
                    held, size = [], 0

    told.mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value")).write.mode(
        "errorifexists").option("lineSep", "\0").text(path)


# --------------------------------------------------------------- salvaging
class Damaged(Exception):
    """A check that failed."""


@dataclass
class Record:
    start: int
    end: int
    fields: dict[str, str] = field(repr=False)
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        """The body of an HTTP message, or the whole block."""
        if not self.fields.get("content-type", "").lower().startswith("application/http"):
            return self.block
        head, gap, body = self.block.partition(b"\r\n\r\n")
        return body if gap else b""


@dataclass
class Gap:
    start: int
    end: int
    reason: str


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    if not stated or ":" not in stated:
        return
    name, _, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return
    found = hashlib.new(name, data, usedforsecurity=False)
    if value.strip().lower() not in (found.hexdigest(), base64.b32encode(found.digest()).decode().lower()):
        raise Damaged(f"{what} digest")


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields in lower case, block, place after the record) of the plain record at ``at``."""
    line = VERSION_LINE.match(data, at)
    if not line:
        raise Damaged("no version line")
    head_end = data.find(b"\r\n\r\n", line.end() - 2, line.end() + HEADER_LIMIT)
    if head_end < 0:
        raise Damaged("header without end")
    fields, last = {}, None
    for raw in data[line.end() : head_end].split(b"\r\n"):
        text = raw.decode("utf-8", "replace")
        if last and text[:1] in (" ", "\t"):  # a folded line
            fields[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon or not name.strip():
            if text:
                raise Damaged("header field")
            continue
        last = name.strip().lower()
        fields[last] = value.strip()
    if not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")) or "warc-type" not in fields:
        raise Damaged("header field")
    begin = head_end + 4
    end = begin + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("truncated block" if end + 4 > len(data) else "no line ends after the block")
    block = data[begin:end]
    _check_digest(fields.get("warc-block-digest"), block, "block")
    return fields, block, end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """(content, place after it) of the gzip member at ``at``."""
    z, parts = zlib.decompressobj(31), []
    while not z.eof:
        if at >= len(data):
            raise Damaged("truncated gzip member")
        try:
            parts.append(z.decompress(data[at : at + FEED]))
        except zlib.error as err:
            raise Damaged("gzip member") from err
        at += FEED
    return b"".join(parts), min(at, len(data)) - len(z.unused_data)


def _whole(r: Record) -> Record:
    if r.fields["warc-type"] != "revisit":
        _check_digest(r.fields.get("warc-payload-digest"), r.payload, "payload")
    return r


def _records_at(data: bytes, at: int) -> tuple[list[Record], int]:
    """The records of the member or the plain record at ``at``, and the place after them."""
    if data.startswith(MEMBER_HEAD, at):
        inner, end = _member(data, at)
        found, i = [], 0
        while i < len(inner):
            fields, block, i = parse_record(inner, i)
            found.append(_whole(Record(at, end, fields, block)))
        return found, end
    fields, block, end = parse_record(data, at)
    return [_whole(Record(at, end, fields, block))], end


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """Records and quarantined gaps of an archive, in order."""
    at = 0
    padding = re.compile(rb"[\0\r\n]*")
    candidate = re.compile(rb"\x1f\x8b\x08|" + VERSION_LINE.pattern)
    while (at := padding.match(data, at).end()) < len(data):
        try:
            found, end = _records_at(data, at)
        except Damaged as err:
            start, reason = at, str(err)
            while True:  # the next place at which a record passes
                nxt = candidate.search(data, at + 1)
                if not nxt:
                    yield Gap(start, len(data), reason)
                    return
                at = nxt.start()
                try:
                    found, end = _records_at(data, at)
                    break
                except Damaged:
                    continue
            yield Gap(start, at, reason)
        yield from found
        at = end


def _long(text: str | None) -> int | None:
    """A foreign archive's field of the same name may hold anything."""
    number = int(text) if text and re.fullmatch(r"-?[0-9]{1,19}", text) else None
    return number if number is not None and -(1 << 63) <= number < 1 << 63 else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per salvaged record or quarantined gap of the archives under ``path``.

    kind (record or gap), archive, start, end (byte range of the record, of its member, or of the gap), reason (of
    a gap), record_type, record_id, refers_to (record id), uri, page_id, payload_digest (of the payload as read; of a
    revisit as stated), payload_bytes (null for a revisit) and, if asked for, payload.
    """
    schema = ("kind string, archive string, start bigint, `end` bigint, reason string, record_type string, record_id string, "
              "refers_to string, uri string, page_id bigint, payload_digest string, payload_bytes bigint, payload binary")

    def row(name: str, x: Record | Gap) -> tuple:
        if isinstance(x, Gap):
            return ("gap", name, x.start, x.end, x.reason, *[None] * 8)
        f, page = x.fields, x.fields.get(PAGE_FIELD.lower())
        revisit, payload = f["warc-type"] == "revisit", x.payload
        digest = f.get("warc-payload-digest", "").rpartition(":")[2] or None if revisit else hashlib.sha256(payload).hexdigest()
        return ("record", name, x.start, x.end, None, f["warc-type"], f.get("warc-record-id"), f.get("warc-refers-to"),
                f.get("warc-target-uri"), _long(page), digest,
                None if revisit else len(payload), payload if payloads and not revisit else None)

    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = ["kind", "archive", "start", "end", "reason", "record_type", "record_id", "refers_to", "uri", "page_id",
             "payload_digest", "payload_bytes", "payload"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                for x in salvage(content.as_py()):
                    held.append(row(name.as_py(), x))
                    size += 1024 + len(held[-1][-1] or b"")
                    if size > BATCH_BYTES:
                        yield batch_of(held)
                        held, size = [], 0
                if held:
                    yield batch_of(held)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    out = files.mapInArrow(run, schema)
    return out if payloads else out.drop("payload")


def resolved(found: DataFrame) -> DataFrame:
    """Rows of pages from salvaged ``found`` (written): a revisit gets the length and page of the response it names.

    page_id, payload_bytes, payload_digest, record_type, refers_to (a page id). A revisit whose response was lost
    keeps its digest and has neither length nor refers_to.
    """
    pages = found.where((F.col("kind") == "record") & F.col("record_type").isin("response", "revisit"))
    responses = materialize(
        pages.where("record_type = 'response'").join(
            pages.where("record_type = 'revisit'").select(F.col("refers_to").alias("record_id")).distinct(), "record_id", "left_semi")
        .groupBy(F.col("record_id").alias("id"), F.col("payload_digest").alias("digest")).agg(
            F.min("page_id").alias("first_id"), F.min("payload_bytes").alias("first_bytes")))
    joined = pages.where("record_type = 'revisit'").join(
        responses, (F.col("refers_to") == F.col("id")) & (F.col("payload_digest") == F.col("digest")), "left")
    again = joined.select("page_id", F.col("first_bytes").alias("payload_bytes"), "payload_digest", "record_type",
                          F.col("first_id").alias("refers_to"))
    own = pages.where("record_type = 'response'").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return own.unionByName(again)
