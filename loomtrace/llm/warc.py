"""WARC writing with payload-level de-duplication, and a reader that salvages damaged archives.

Archives are rows (archive, content) of a table in the shared folder: the bytes of ``content`` are a
whole .warc or .warc.gz file as any reader takes it, and files of others come in by Spark's ``binaryFile``
source. A cell holds 2 GB at most, so that larger archives have to be cut at members first.

Salvage works on the stored bytes and inside gzip members: after a failed check the next valid version
line (or member) is searched for, later records are recovered, and the bytes between are logged as a
gap. Of a cut member all is used that inflates before the cut, of one that does not
inflate to its check sum every record before the damage that has a digest of its own; the gap of a whole member
spans its stored bytes, one inside a member names its bytes in the reason.

Defined results of the edge cases:

* null html is an empty payload, null url an empty target URI; an empty table gives no archives;
* repeated page rows give one record each; equal payloads refer to the smallest page_id;
* a null page_id is written as ``null`` and read back as null; it is a response only if no equal
  payload has a page_id;
* extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import kernels as K
from loomtrace.llm.storage import materialise

#: Payloads below this many bytes are stored again rather than referred to.
REVISIT_MIN_BYTES = 100
ARCHIVE_BYTES = 8 << 20
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ARCHIVE = pa.schema([("archive", pa.string()), ("content", pa.binary())])
EVENTS = pa.schema(
    [("kind", pa.string()), ("archive", pa.string()), ("begin_byte", pa.int64()), ("end_byte", pa.int64()), ("reason", pa.string())]
    + [("page_id", pa.int64()), ("target_uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def plan_records(pages: DataFrame) -> DataFrame:
    """Adds the record type of every page: the payload groups are aggregated before any row is joined."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumns({"digest": F.sha2("html", 256), "size": F.octet_length("html").cast("long")})
    groups = (
        base.where(F.col("size") >= REVISIT_MIN_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .drop("copies")
    )
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    return base.join(groups, "digest", "left").select(
        "page_id",
        "url",
        F.when(~revisit, F.col("html")).alias("html"),
        "digest",
        "size",
        F.when(revisit, F.col("first_page")).alias("refers_to"),
    )


def encode_record(page_id: int | None, url: str, html: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; ``html`` is None for a revisit."""
    kind = "response" if html is not None else "revisit"
    payload = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload
    uri = re.sub(r"[\x00-\x20]+", "%20", url)
    fields = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:loomtrace:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        fields += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:loomtrace:page:{refers_to}>"]
    fields.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, compress: bool = True) -> DataFrame:
    """Rows (archive, content): WARC files of about 8 MB, one gzip member a record if ``compress``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def archive() -> pa.RecordBatch:
            name = f"part-{part:06d}-{count:05d}.warc" + ".gz" * compress
            return pa.RecordBatch.from_pydict({"archive": [name], "content": [b"".join(held)]}, ARCHIVE)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                record = encode_record(*row)
                if compress:
                    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
                    record = squeeze.compress(record) + squeeze.flush()
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    count, held, size = count + 1, [], 0
        if held:
            yield archive()

    return K.map_arrow(plan_records(pages), pack, ARCHIVE)


_HEAD_END = re.compile(rb"\r?\n\r?\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_RESUME = re.compile(rb"WARC/1\.[01]\r?\n|\x1f\x8b\x08")
_PIECE = 32 << 10


class Damaged(ValueError):
    """A record that fails a check; the message is the reason that is logged."""


def parse_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields, block and end of the record at ``start``; raises Damaged."""
    if not _VERSION.match(data, start):
        raise Damaged("no version line")
    end = _HEAD_END.search(data, start)
    if not end:
        raise Damaged("unfinished header")
    fields = {}
    for line in data[start : end.start()].splitlines()[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("malformed header line")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("bad content length")
    stop = end.end() + int(length)
    if stop > len(data):
        raise Damaged("truncated block")
    block = data[end.end() : stop]
    named, _, digest = fields.get("warc-block-digest", "").partition(":")
    if named.lower() == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise Damaged("block digest differs")
    tail = re.compile(rb"\r?\n\r?\n|\Z").match(data, stop)
    if not tail:
        raise Damaged("no record end")
    return fields, block, tail.end()


def inflate(data: bytes, start: int) -> tuple[bytes, int, str]:
    """What the gzip member at ``start`` inflates to, the end of the bytes read, and its damage (or nothing)."""
    expand, pieces, end = zlib.decompressobj(31), [], start
    while not expand.eof and end < len(data):
        piece = data[end : end + _PIECE]
        before = expand.copy()
        try:
            pieces.append(expand.decompress(piece))
        except zlib.error as error:
            # the failed call gave nothing back: its bytes go in one by one up to the damage
            for k in range(len(piece)):
                try:
                    pieces.append(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    return b"".join(pieces), end + k, f"gzip: {error}"
        end += len(piece)
    return b"".join(pieces), end - len(expand.unused_data), "" if expand.eof else "truncated gzip member"


def plain_records(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of uncompressed bytes, covering them in order."""
    at, gap, reason = 0, None, ""
    while at < len(data):
        try:
            fields, block, end = parse_record(data, at)
        except Damaged as error:
            if gap is None:
                gap, reason = at, str(error)
            following = _VERSION.search(data, at + 1)
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, (fields, block)
        at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", begin, end, (fields, block)) and ("gap", begin, end, reason) by places in ``data``.

    After a failed check the next gzip member or version line that yields a whole valid record is
    searched for; all bytes skipped on the way are one quarantined gap with the first reason. Records
    and gaps inside a member carry the member's place.
    """
    at, gap, reason = 0, None, ""
    while at < len(data):
        if data.startswith(_MEMBER, at):
            plain, end, damage = inflate(data, at)
            found = [(kind, at, end, what if kind == "record" else f"{what} (bytes {b} to {e} of the expanded member)") for kind, b, e, what in plain_records(plain)]
            if damage.startswith("gzip"):
                # bytes that inflate may be wrong: only a record's own digest vouches for it
                found = [f for f in found if f[0] == "gap" or f[3][0].get("warc-block-digest", "").lower().startswith("sha256:")]
            if not any(f[0] == "record" for f in found):
                damage, found = damage or (f"{found[0][3]}" if found else "empty gzip member"), []
            elif damage and found[-1][0] == "gap":
                found.pop()  # the record that the damage cut
        else:
            damage, found, end = "", [], at
            try:
                fields, block, end = parse_record(data, at)
                found = [("record", at, end, (fields, block))]
            except Damaged as error:
                damage = str(error)
        if gap is not None and found:
            yield "gap", gap, at, reason
            gap = None
        yield from found
        if damage:
            if gap is None:
                gap, reason = at, damage
            following = _RESUME.search(data, at + 1)
            at = following.start() if following else len(data)
        else:
            at = end
    if gap is not None:
        yield "gap", gap, len(data), reason


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:loomtrace:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record and every quarantined gap of the archives (columns: ``EVENTS``).

    Takes (archive, content), as ``write_archives`` returns them or as Spark's ``binaryFile`` source
    gives them after renaming ``path``. Records whose payload does not have the digest they state are
    quarantined too.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for kind, begin, end, what in salvage(content or b""):
                    row = dict.fromkeys(EVENTS.names) | {"kind": kind, "archive": archive, "begin_byte": begin, "end_byte": end}
                    if kind == "gap":
                        row["reason"] = what
                    else:
                        fields, block = what
                        head = _HEAD_END.search(block)
                        payload = block[head.end() :] if head and fields.get("content-type", "").startswith("application/http") else block
                        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:").lower()
                        revisit = fields.get("warc-type") == "revisit"
                        digest = stated if revisit else hashlib.sha256(payload).hexdigest()
                        if stated and digest != stated:
                            row |= {"kind": "gap", "reason": "payload digest differs"}
                        else:
                            size = fields.get("x-payload-length", "")
                            row |= {
                                "page_id": _page(fields.get("warc-record-id")),
                                "target_uri": fields.get("warc-target-uri"),
                                "record_type": fields.get("warc-type"),
                                "refers_to": _page(fields.get("warc-refers-to")),
                                "payload": None if revisit else payload,
                                "payload_bytes": (int(size) if size.isdigit() else None) if revisit else len(payload),
                                "payload_digest": digest,
                            }
                            held += len(payload)
                    rows.append(row)
                    if held > 4 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, EVENTS)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, EVENTS)

    return K.map_arrow(archives.select("archive", "content"), read, EVENTS)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Writes all pages into archives in the shared folder and reads those archives back."""
    return read_archives(materialise(write_archives(pages), "warc"))
