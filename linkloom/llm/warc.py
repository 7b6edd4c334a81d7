"""WARC archives: writing, and a reader that salvages what follows damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.store import attach, write_table

VERSION = b"WARC/1.1"
# Bytes of payload after which a new archive is begun.
ARCHIVE_BYTES = 4_000_000
_MEMBER = b"\x1f\x8b\x08"
_PIECE = 1 << 16
_DATE = "2020-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: str, url: str, payload: bytes | None, size: int, sha1: str, refers_to: str | None) -> bytes:
    """One record as a gzip member. A revisit has the HTTP head of the page, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    head = [VERSION.decode(), f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {url}",
            f"WARC-Payload-Digest: sha1:{sha1}", f"WARC-Block-Digest: sha1:{digest(block)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                     f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Record:
    """``head``: fields in lower case; ``block``: what follows the header; ``sound``: not from a member that is broken, cut
    or fails its checksum (there only the block has been checked, by its digest)."""
    at: int
    head: dict[str, str]
    block: bytes = field(repr=False)
    sound: bool = True

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        top, _, body = self.block.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, body


def _parse(data: bytes, at: int) -> tuple[Record, int] | None:
    """The record that begins at ``at`` in plain WARC bytes, and where it ends; None if a check fails."""
    if not data.startswith(b"WARC/", at):
        return None
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        return None
    head = {}
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        k, colon, v = line.partition(":")
        if not colon:
            return None
        head[k.strip().lower()] = v.strip()
    length = head.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in head:
        return None
    begin, end = stop + 4, stop + 4 + int(length)
    if data[end:end + 4] != b"\r\n\r\n":
        return None
    block = data[begin:end]
    asked = head.get("warc-block-digest", "")
    if asked.startswith("sha1:") and asked[5:] != digest(block):
        return None
    return Record(at, head, block), end + 4


def _member(data: bytes, at: int) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, as far as it can be decompressed, and its end; None if it is broken, cut or
    fails its checksum."""
    z, out = zlib.decompressobj(31), []
    view = memoryview(data)
    for lo in range(at, len(data), _PIECE):
        try:
            out.append(z.decompress(view[lo:lo + _PIECE]))
        except zlib.error:
            # What comes before the broken place within this piece is still good.
            out.append(_before_error(view[at:lo + _PIECE], sum(map(len, out))))
            return b"".join(out), None
        if z.eof:
            return b"".join(out), min(lo + _PIECE, len(data)) - len(z.unused_data)
    return b"".join(out), None


def _before_error(view: memoryview, known: int) -> bytes:
    """What a broken member gives beyond ``known`` bytes before the error."""
    z, out = zlib.decompressobj(31), []
    try:
        for byte in range(0, len(view), 64):
            out.append(z.decompress(view[byte:byte + 64]))
    except zlib.error:
        pass
    return b"".join(out)[known:]


def _inside(plain: bytes, at: int) -> list[Record | tuple[int, int]]:
    """Records of decompressed bytes, and (from, to) in them of what lies between: after a failed check the next version
    line from which a valid record follows is sought."""
    out: list = []
    inner, bad = 0, None
    while inner < len(plain):
        found = _parse(plain, inner)
        if found is None:
            bad = inner if bad is None else bad
            inner = plain.find(b"WARC/", inner + 1)
            inner = len(plain) if inner < 0 else inner
            continue
        if bad is not None:
            out.append((bad, inner))
            bad = None
        out.append(Record(at, found[0].head, found[0].block))
        inner = found[1]
    return out + ([(bad, len(plain))] if bad is not None else [])


def salvage(data: bytes) -> Iterator[Record | tuple[int, ...]]:
    """Records of an archive, compressed by record, by several or plain, and (from, to) for each byte gap given up. A gap
    inside a member whose other records are good is (from, to of the member, from, to in its decompressed bytes).

    Where a member or record fails a check (checksum, header, length, end, block digest), the search goes on for the next
    place where a gzip member or version line begins and a whole, valid record follows, inside a member too. Of a broken
    or cut member the records before the error are returned. Records after the damage are returned as usual.
    """
    at, bad = 0, None
    while at < len(data):
        got: list = []
        end = None
        if data.startswith(_MEMBER, at):
            plain, end = _member(data, at)
            got = _inside(plain, at)
            if not any(isinstance(x, Record) for x in got):
                got, end = [], None
        elif (p := _parse(data, at)) is not None:
            got, end = [p[0]], p[1]
        if got and bad is not None:
            yield bad, at
            bad = None
        for x in got:
            if isinstance(x, Record):
                x.sound = end is not None
                yield x
            elif end is not None:
                yield at, end, *x
        if end is not None:
            at = end
            continue
        bad = at if bad is None else bad
        nexts = [x for x in (data.find(_MEMBER, at + 1), data.find(b"WARC/", at + 1)) if x >= 0]
        at = min(nexts, default=len(data))
    if bad is not None:
        yield bad, len(data)


def assign_types(pages: DataFrame, key: str = "page_id", text: str = "html", least: int = 0) -> DataFrame:
    """``pages`` with payload_bytes, payload_sha1 (hex) and refers_to.

    Of the rows with equal payloads of ``least`` bytes or more, that with the greatest key is kept as a response
    and the others refer to it. Rows with that key, and rows of groups without a key, refer to nothing.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_sha1", F.sha1(body))
    same = ["payload_sha1", "payload_bytes"]
    # Only groups of equal payloads are looked up: the list is narrow, and pages do not travel while it can be broadcast.
    first, count = write_table(rows.groupBy(*same).agg(F.max(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
                               .where("_n > 1").drop("_n"), "warc")
    rows = attach(rows, first, same, "left", count)
    other = (F.col("_first") != F.coalesce(F.col(key), F.col("_first") - 1)) & (F.col("payload_bytes") >= least)
    return rows.withColumn("refers_to", F.when(other, F.col("_first"))).drop("_first")


def damaged(member: bytes) -> bytes:
    """A copy of a record of which the middle is overwritten and the end is cut."""
    half = len(member) // 2
    return member[:half] + bytes(b ^ 0xFF for b in member[half:half + 8]) + member[half + 8:-8]


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", broken: int = 0) -> DataFrame:
    """content (binary): archives of about ``ARCHIVE_BYTES``, each some gzip members, of the rows of
    ``assign_types``. An archive is a row here, so it is stored wherever Spark stores tables. With ``broken``, a damaged
    copy follows after every so many records, as a reader finds it in archives that were cut off and written anew."""
    rows = pages.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.when(F.col("refers_to").isNull(), F.col(text)).alias("body"), "payload_bytes",
                        "payload_sha1", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, written = [], 0, 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                page, where, body, n, sha1, other = r
                where = "".join(where.split())
                held.append(record(page or "", where, body.encode() if body else None, n,
                                   base64.b32encode(bytes.fromhex(sha1)).decode(), other))
                size += n
                written += 1
                if broken and written % broken == 0:
                    held.append(damaged(held[-1]))
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)])], names=["content"])

    return rows.mapInArrow(run, "content binary")


def read_archives(archives: DataFrame, content: str = "content") -> DataFrame:
    """One row per record of the archives in column ``content``, and one per quarantined gap (record_type 'gap').

    ``archives`` may come from ``write_archives`` or from ``spark.read.format("binaryFile")``. archive: MD5 of the
    archive; at, until: its bytes; inner_at, inner_until: of a gap inside a member, its place in the decompressed bytes.
    Of a gap, only these are set. gap_bytes: of a record, the bytes given up just before it. Null archives have no rows.
    payload_bytes and payload_digest: of a response what was read, and valid tells whether that is what the record
    says; of a revisit what the record says. sound: see ``Record``.
    """
    names = ("archive", "at", "until", "record_type", "page_id", "url", "payload_bytes", "payload_digest", "refers_to",
             "valid", "payload", "sound", "inner_at", "inner_until", "gap_bytes")
    bare = lambda s: s.removeprefix("<urn:page:").removesuffix(">")

    def rows(data: bytes) -> Iterator[tuple]:
        name = hashlib.md5(data).hexdigest()
        lost = 0
        for x in salvage(data):
            if isinstance(x, tuple):
                lost += x[-1] - x[-2]
                yield (name, *x[:2], "gap", *[None] * 8, *(x[2:] or (None, None)), None)
                continue
            http, body = x.http
            said = x.head.get("warc-payload-digest", "").removeprefix("sha1:")
            kind, other = x.head["warc-type"], x.head.get("warc-refers-to")
            told = http.get("content-length", "")
            n = len(body) if kind != "revisit" else int(told) if told.isdigit() else None
            got = digest(body) if kind != "revisit" else said
            yield (name, x.at, None, kind, bare(x.head.get("warc-record-id", "")), x.head.get("warc-target-uri"), n, got,
                   other and bare(other), got == said, body if kind != "revisit" else None, x.sound, None, None, lost)
            lost = 0

    schema = ("archive string, at bigint, until bigint, record_type string, page_id string, url string, "
              "payload_bytes bigint, payload_digest string, refers_to string, valid boolean, payload binary, sound boolean, "
              "inner_at bigint, inner_until bigint, gap_bytes bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one in b.column(0):
                if one.is_valid:
                    got = list(rows(one.as_py()))
                    for lo in range(0, len(got), 500):
                        cols = list(zip(*got[lo:lo + 500]))
                        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string(),
                                 pa.string(), pa.bool_(), pa.binary(), pa.bool_(), *[pa.int64()] * 3]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))

    return archives.select(content).mapInArrow(run, schema)
