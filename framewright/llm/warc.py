"""WARC archives: a writer that deduplicates payloads, and a salvage reader.

Writing goes through Spark's text sink, so files appear by its commit protocol on any file system that Spark reaches, and
a lost executor leaves no half archive.  Each record is a gzip member of its own followed by one zero byte (padding
between members, which readers of gzip pass over).  Reading checks every record of an archive, whether members hold one
record or many; where a check fails, it searches for the next member or version line that holds a valid record, and
reports the bytes between as a gap.  Whole records at the head of a damaged member are read as well, and marked so.
"""

from __future__ import annotations

import base64
import hashlib
import logging
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bloom import cells, filter_bits, from_cells
from ._util import durable

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC, _START = b"\x1f\x8b\x08", re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_PAD = re.compile(rb"\x00*")
_VERSION_LINE = re.compile(rb"WARC/1\.\d+\r\n")
#: A header ends at an empty line, however long it is; the next version line shows that its end is lost.
_HEADER_STOP = re.compile(rb"\r\n(?:\r\n|WARC/1\.\d+\r\n)")


def digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line: characters that could break it are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """A response or revisit record; a revisit keeps the HTTP head of its page, with the payload's length, and no payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:record:{_clean(record_id)}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:record:{_clean(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


#: Bytes of inflated records that wait for their member's checksum; beyond, records are given out on their block digest.
HELD = 64 << 20
#: Compressed bytes that a writer packs into one line of its sink, and lines of a file: archives hold about 64 MiB, and one record at least.
PACK, PACKS = 8 << 20, 8


@dataclass
class Piece:
    """A record, or a gap: bytes that no valid record covers, and why.

    start and stop are bytes of the archive: of the record, or of the gzip member that holds it, where offset tells the place.
    inside: records that could be read from the head of a damaged member.
    """

    start: int
    stop: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    offset: int = 0
    inside: list[Piece] = field(default_factory=list)


class Damaged(Exception):
    pass


class Short(Damaged):
    """The record may go on behind the bytes that are there."""


def parse(buf, at: int) -> Piece:
    """The record that starts at `at`; raises Damaged unless it is whole and its block digest holds."""
    version = _VERSION_LINE.match(buf, at)
    if not version:
        raise (Short if len(buf) - at < 16 else Damaged)("no version line")
    found = _HEADER_STOP.search(buf, version.end() - 2)
    if not found:
        raise Short("header does not end")
    if found[0] != b"\r\n\r\n":
        raise Damaged("header does not end")
    end = found.start()
    headers: dict[str, str] = {}
    for line in bytes(buf[at:end]).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d{1,18}", length):
        raise Damaged("no content length")
    stop = end + 4 + int(length)
    if stop + 4 > len(buf):
        raise Short("content length does not hold")
    if bytes(buf[stop : stop + 4]) != b"\r\n\r\n":
        raise Damaged("content length does not hold")
    block = bytes(buf[end + 4 : stop])
    kind, _, want = headers.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1" and want.upper() != digest(block):
        raise Damaged("block digest does not hold")
    return Piece(at, stop + 4, None, headers, block)


class _Member:
    """Reads the records of the gzip member at `at` as it inflates.  Afterwards, stop is where it ends; reason tells what is
    wrong with the member itself, and lost what is wrong with a record of it."""

    def __init__(self, buf, at: int) -> None:
        self.buf, self.at, self.stop = buf, at, at
        self.reason: str | None = None
        self.lost: str | None = None

    def records(self) -> Iterator[Piece]:
        z, raw, place, final = zlib.decompressobj(31), bytearray(), 0, False
        while True:
            while raw:
                try:
                    got = parse(raw, 0)
                except Damaged as x:
                    if isinstance(x, Short) and not final:
                        break
                    self.lost = self.lost or str(x)
                    again = _VERSION_LINE.search(raw, 1)
                    cut = again.start() if again else len(raw) if final else max(0, len(raw) - 16)
                    if not cut:
                        break
                    place += cut
                    del raw[:cut]
                    continue
                yield Piece(self.at, self.stop, None, got.headers, got.block, place)
                place += got.stop
                del raw[: got.stop]
            if final:
                return
            if z.eof:
                self.stop -= len(z.unused_data)
                final = True
            elif self.stop >= len(self.buf):
                self.reason, final = "member is cut off", True
            else:
                part = self.buf[self.stop : self.stop + 65536]
                self.stop += len(part)
                try:
                    raw += z.decompress(part)
                except zlib.error:
                    self.reason, final = "member does not inflate", True


def _member(buf, at: int) -> Iterator[Piece]:
    """The records of a member, and a gap where some are lost; raises Damaged, with those of its head, if it is damaged itself."""
    m, held, size, given = _Member(buf, at), [], 0, False
    for r in m.records():
        held.append(r)
        size += len(r.block)
        if size > HELD:
            yield from held
            held, size, given = [], 0, True
    if m.reason is not None or not (held or given):
        raise Damaged(m.reason or m.lost or "member is empty", held)
    for r in held:
        r.stop = m.stop
        yield r
    if m.lost:
        yield Piece(at, m.stop, m.lost)


def salvage(archive: bytes) -> Iterator[Piece]:
    """All valid records of an archive in order, and the gaps between them; together they cover all bytes but padding."""
    buf = memoryview(archive).cast("B")
    at, bad, reason, inside = 0, None, None, []
    while at < len(buf):
        if bad is None:
            at = _PAD.match(buf, at).end()
            if at >= len(buf):
                return
        pieces = _member(buf, at) if buf[at : at + 3] == _MAGIC else iter([at])
        done = False
        try:
            for got in pieces:
                got = parse(buf, at) if isinstance(got, int) else got
                if bad is not None:
                    yield Piece(bad, at, reason, inside=inside)
                    bad, inside = None, []
                yield got
                done, last = True, got.stop
        except Damaged as x:
            if bad is None:
                bad, reason = at, str(x.args[0])
            inside += x.args[1] if len(x.args) > 1 else []
            found = _START.search(buf, at + 1)
            at = found.start() if found else len(buf)
            continue
        if done:
            at = last
    if bad is not None:
        yield Piece(bad, len(buf), reason, inside=inside)


def plan_records(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """(id, url, payload, kind, refers_to): which page is the response of its payload, and which revisit it.

    Payloads shuffle only where a Bloom filter of repeated digests says that there may be copies.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha", F.unhex(F.sha1("payload")))
    counted = p.where(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = durable(counted.where("n > 1 and first is not null").select("sha", "first"), "warc-firsts")
    bits = filter_bits(firsts.count(), 16, 1 << 28)
    key = F.xxhash64("sha")
    copies = from_cells(firsts.select(F.explode(F.array(*cells(key, bits))).alias("cell")), bits, "warc-filter")
    p = copies.maybe(p, key, "maybe")
    alone = p.where("not maybe").select("id", "url", "payload", F.lit("response").alias("kind"), F.lit(None).cast(p.schema["id"].dataType).alias("refers_to"))
    met = p.where("maybe").join(firsts, "sha", "left")
    revisit = (F.octet_length("payload") >= min_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    met = met.select("id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))
    return alone.unionByName(met)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> None:
    """Write a record per row of pages into gzip archives under path.

    Of rows with equal payloads of at least min_bytes, that with the smallest id is the response and the others
    revisit it; rows repeated with that same id are responses as well.  Null payload: empty.  Null ids: never the
    smallest; where all ids of a payload are null, all rows are responses.  Null url: no target header.  Empty
    table: no records.  Files are rolled by bytes (PACK, PACKS), so that an archive fits in memory when it is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held = [], 0  # members go on from batch to batch, so packs are full but for the last

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"\0".join(pack)], pa.binary())], ["pack"])

        for b in batches:
            for i in range(b.num_rows):
                key, url, payload, kind, to = (b.column(j)[i] for j in range(5))
                raw = record(kind.as_py(), key.as_py() if key.is_valid else "", url.as_py(), payload.as_buffer().to_pybytes(), to.as_py(), date)
                pack.append(gzip_member(raw, level))
                held += len(pack[-1])
                if held > PACK:
                    yield packed()
                    pack, held = [], 0
        if pack:
            yield packed()

    rows = plan_records(pages, id_col, url_col, body_col, min_bytes)
    rows = rows.select(F.col("id").cast("string"), F.col("url").cast("string"), "payload", "kind", F.col("refers_to").cast("string"))
    rows.mapInArrow(run, "pack binary").select(F.col("pack").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", PACKS).text(path)


def _http(block: bytes) -> tuple[int | None, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    return (int(found[1]) if found else None), body


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of all archives under path, plain or gzip, one row each.

    kind is `record`, `gap`, or `salvaged`: a whole record, its block digest holding, from the head of a damaged member, within a
    gap.  start and stop are bytes of the file, offset the place in the inflated member; reason says why a gap's first
    record failed.  Records have record_type, record_id, refers_to, uri, payload_bytes and payload_digest (bare base32 SHA-1): of the payload read
    where there is one, else as the headers tell.  payloads adds the payload itself.  Empty files give no rows.
    A file is one value of Spark's reader, so it must be smaller than 2 GiB; its records are inflated one by one.
    """
    names = ["file", "kind", "start", "stop", "offset", "reason", "record_type", "record_id", "refers_to", "uri", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *([pa.binary()] if payloads else [])]

    def row(name: str, p: Piece, kind: str) -> tuple:
        if kind == "gap":
            return (name, kind, p.start, p.stop, 0, p.reason, *[None] * (len(names) - 6))
        h, told = p.headers, p.headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        size, body = _http(p.block) if h.get("content-type", "").startswith("application/http") else (len(p.block), p.block)
        if h.get("warc-type") != "revisit":
            size, told = len(body), digest(body)
        bare = lambda x: x and re.sub(r"^<urn:record:(.*)>$", r"\1", x)
        return (name, kind, p.start, p.stop, p.offset, None, h.get("warc-type"), bare(h.get("warc-record-id")), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), size, told, *([body] if payloads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, held = [], 0
                for p in salvage(content.as_buffer()):
                    rows.append(row(name.as_py(), p, "record" if p.reason is None else "gap"))
                    rows += [row(name.as_py(), r, "salvaged") for r in p.inside]
                    held += sum(len(r.block) for r in (p, *p.inside)) if payloads else 100
                    if held > 16_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "file string, kind string, start long, stop long, offset long, reason string, record_type string, record_id string, refers_to string, uri string, payload_bytes long, payload_digest string"
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, schema + (", payload binary" if payloads else ""))


def gap_log(records: DataFrame, path: str) -> int:
    """Write the gaps of read_warc as JSON lines under path (file, start, stop, reason) and tell of them; returns their number."""
    gaps = records.where("kind = 'gap'").select("file", "start", "stop", "reason")
    n, lost = gaps.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0))).first()
    if n:
        gaps.write.json(path)
        logging.getLogger(__name__).warning("%d gaps of %d bytes are quarantined, see %s", n, lost, path)
    return n
