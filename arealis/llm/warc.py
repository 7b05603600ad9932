"""WARC archives: written as one gzip stream each, normalised to a gzip member per record, read by an index.

``write_monolithic`` makes archives whose whole file is one gzip stream, as
many crawlers leave them.  ``normalise`` takes these or any others, inflates
each stream once, from start to end, writes every record as its own member and
a sidecar index of record id, offset and length, so that a record can be read
alone.  ``read_records`` reads records of any type and origin.

An archive is stored as rows (archive, part, content) whose contents in order
are the file; parts are bounded, so an archive of any size is streamed through
a task.  Tables instead of files keep every write on Spark's own committer.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arealis.llm.spread import keep

ARCHIVE_BYTES = 32 << 20
PART_BYTES = 1 << 20
LEVEL = 6
_GZIP = 31  # zlib window bits for a gzip wrapper
#: bytes inflated at a time, however far a part expands
INFLATE_BYTES = 4 << 20
_DATE = "1970-01-01T00:00:00Z"
_MADE = "urn:record:"  # record ids of pages that have none


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, made_id: str = "") -> bytes:
    """One WARC record; a revisit carries no payload but names its digest and size.

    A page without an id goes under ``made_id``.
    """
    kind = "response" if refers_to is None else "revisit"
    record_id = f"{_MADE}{made_id}" if page_id is None else f"urn:page:{page_id}"
    block = payload if refers_to is None else b""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{record_id}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields of a record's head, names in lower case."""
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    return fields


# ---------------------------------------------------------------- writing

_PARTS = "archive string, part int, content binary"
_PARTS_ARROW = pa.schema([("archive", pa.string()), ("part", pa.int32()), ("content", pa.binary())])


def _stream(archive_bytes: int, part_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        packer, waiting, part, raw = None, bytearray(), 0, 0

        def rows(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal part
            while len(waiting) >= part_bytes or (final and waiting):
                piece = bytes(waiting[:part_bytes])
                del waiting[:part_bytes]
                yield pa.RecordBatch.from_pylist([{"archive": f"{task:06d}-{number:06d}", "part": part, "content": piece}], _PARTS_ARROW)
                part += 1

        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            others = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for i, (page_id, url, digest, refers_to) in enumerate(zip(*others)):
                packer = packer or zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                record = record_bytes(page_id, url, payloads[i].as_py(), digest, refers_to, f"{task:06d}-{number:06d}-{raw}")
                waiting += packer.compress(record)
                raw += len(record)
                if raw >= archive_bytes:
                    waiting += packer.flush()
                    yield from rows(final=True)
                    packer, part, raw, number = None, 0, 0, number + 1
                else:
                    yield from rows(final=False)
        if packer:
            waiting += packer.flush()
            yield from rows(final=True)

    return run


def write_monolithic(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    archive_bytes: int = ARCHIVE_BYTES,
    part_bytes: int = PART_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Archives of ``pages``, each one gzip stream.

    Of pages with equal payloads the one with the smallest id is a response,
    the others are revisits that refer to it.  A null payload is empty; rows
    with a null id get a made-up record id and are responses, to which nothing
    refers.  Of rows that repeat an id and payload all are written.
    """
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("sha1"),
    )
    # only payloads that occur more than once need a look-up
    first = rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = keep(first.where("first <> last").select("sha1", "first"), "repeated-payloads")
    refers_to = F.when(F.col("first") < F.col("page_id"), F.col("first"))
    records = rows.join(first, "sha1", "left").select(
        "page_id", "url", "payload", _base32("sha1").alias("digest"), refers_to.alias("refers_to")
    )
    return keep(records.mapInArrow(_stream(archive_bytes, part_bytes, level), _PARTS), "archives")


def _base32(hex_column: str):
    """Base32 of 20 bytes given as 40 hex digits: eight groups of 5 bits from each 5 bytes."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = []
    for g in range(4):
        number = F.conv(F.substring(hex_column, g * 10 + 1, 10), 16, 10).cast("bigint")
        for k in range(8):
            digit = F.shiftright(number, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")
            groups.append(F.substring(F.lit(letters), digit + 1, F.lit(1)))
    return F.concat(*groups)


# ---------------------------------------------------------------- normalising

_MEMBER = "struct<record_id: string, type: string, offset: bigint, length: int>"
_NORMAL = f"archive string, part int, start bigint, content binary, members array<{_MEMBER}>"
_NORMAL_ARROW = pa.schema(
    [
        ("archive", pa.string()), ("part", pa.int32()), ("start", pa.int64()), ("content", pa.binary()),
        ("members", pa.list_(pa.struct([("record_id", pa.string()), ("type", pa.string()), ("offset", pa.int64()), ("length", pa.int32())]))),
    ]
)


class _Records:
    """Cuts inflated bytes, given piece by piece, into whole records."""

    def __init__(self):
        self.held = bytearray()
        self.need = 0  # bytes of the next record, 0 while its head is not complete
        self.fields: dict[str, str] = {}
        self.looked = 0

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.held += piece
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n", max(0, self.looked - 3))
                if end < 0:
                    self.looked = len(self.held)
                    return
                self.fields = parse_head(bytes(self.held[:end]))
                if not self.fields.get("content-length", "").isdigit():
                    raise ValueError(f"record {self.fields.get('warc-record-id')} does not state its length")
                self.need, self.looked = end + 4 + int(self.fields["content-length"]) + 4, 0
            if len(self.held) < self.need:
                return
            record = bytes(self.held[: self.need])
            del self.held[: self.need]
            self.need = 0
            yield self.fields, record

    def end(self, archive: str | None) -> None:
        """Raise where the archive ends inside a record."""
        if self.held.strip(b"\r\n"):
            raise ValueError(f"archive {archive} ends inside a record, {len(self.held)} bytes into it")


def _normaliser(part_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, inflate, records, inside = None, None, _Records(), False  # inside: a gzip stream has begun
        content, members, part, start = bytearray(), [], 0, 0

        def row():
            return pa.RecordBatch.from_pylist([{"archive": archive, "part": part, "start": start, "content": bytes(content), "members": members}], _NORMAL_ARROW)

        def end():
            if inside:
                raise ValueError(f"archive {archive} ends inside its gzip stream")
            records.end(archive)

        for batch in batches:
            for name, piece in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                if name != archive:
                    end()
                    if members:
                        yield row()
                    archive, inflate, records, inside = name, zlib.decompressobj(_GZIP), _Records(), False
                    content, members, part, start = bytearray(), [], 0, 0
                while piece:  # a stream may also hold several members already, and padding after them
                    if not inside and not (piece := piece.lstrip(b"\0")):
                        break
                    raw = inflate.decompress(piece, INFLATE_BYTES)
                    inside = not inflate.eof
                    piece = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
                    if inflate.eof:
                        inflate = zlib.decompressobj(_GZIP)
                    for fields, record in records.feed(raw):
                        packer = zlib.compressobj(level, zlib.DEFLATED, _GZIP)
                        member = packer.compress(record) + packer.flush()
                        members.append({
                            "record_id": fields.get("warc-record-id", ""), "type": fields.get("warc-type", ""),
                            "offset": start + len(content), "length": len(member),
                        })
                        content += member
                        if len(content) >= part_bytes:
                            yield row()
                            start += len(content)
                            content, members, part = bytearray(), [], part + 1
        end()
        if members:
            yield row()

    return run


def normalise(archives: DataFrame, *, part_bytes: int = PART_BYTES, level: int = LEVEL) -> tuple[DataFrame, DataFrame]:
    """Rewrite ``archives`` with one gzip member per record.

    Returns the new archives (archive, part, start, content; no member crosses
    a part) and the sidecar index (archive, part, record_id, type, offset,
    length; offsets count from the start of the archive).  An archive is read
    in the order of its parts by one task, because a gzip stream can only be
    inflated from its start, a few megabytes at a time; there are as many tasks
    as archives.  One that ends inside a record or its gzip stream is an error.
    """
    count = archives.select("archive").distinct().count()
    ordered = archives.repartition(max(1, count), "archive").sortWithinPartitions("archive", "part")
    stored = keep(ordered.mapInArrow(_normaliser(part_bytes, level), _NORMAL), "normalised")
    index = stored.select("archive", "part", F.explode("members").alias("m")).select("archive", "part", "m.*")
    return stored, keep(index, "index")


# ---------------------------------------------------------------- reading

_READ = (
    "record_id string, record_type string, page_id bigint, target_uri string, content_type string, payload_bytes bigint, "
    "payload_digest string, digest_matches boolean, refers_to_id string, refers_to bigint, payload binary"
)
_READ_ARROW = pa.schema(
    [
        ("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()),
        ("content_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_matches", pa.bool_()),
        ("refers_to_id", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ]
)


def _page(urn: str | None) -> int | None:
    """The page of a record id made here; null for any other."""
    name = urn.removeprefix("urn:page:") if urn else ""
    return int(name) if name != urn and name.removeprefix("-").isdigit() else None


def read_record(record: bytes) -> dict:
    """What a record says of itself and its payload.

    The payload of an HTTP message is its body; of any other record the whole
    block.  A record without a payload digest gets that of its payload, a
    revisit (which has none) null.  ``digest_matches`` compares a stated SHA-1
    with a payload that is there, and is null where it cannot.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    payload = rest[: int(fields["content-length"])]
    kind, content = fields.get("warc-type", ""), fields.get("content-type", "")
    if content.replace(" ", "").lower().startswith("application/http"):
        payload = payload.partition(b"\r\n\r\n")[2]
    carried = kind != "revisit"
    stated = fields.get("warc-payload-digest", "")
    algorithm, colon, value = stated.partition(":")
    known = value if algorithm.lower() == "sha1" else stated if colon else None
    own = digest_of(payload) if carried else None
    size = fields.get("x-payload-length", "")  # a revisit made here states what it does not carry
    bare = lambda name: fields[name].strip("<>") if name in fields else None
    return {
        "record_id": bare("warc-record-id"), "record_type": kind, "page_id": _page(bare("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"), "content_type": content or None,
        "payload_bytes": len(payload) if carried else int(size) if size.isdigit() else None,
        "payload_digest": known or own,
        "digest_matches": own == value.upper() if carried and algorithm.lower() == "sha1" else None,
        "refers_to_id": bare("warc-refers-to"), "refers_to": _page(bare("warc-refers-to")),
        "payload": payload if carried else None,
    }


def _reader(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content, places in zip(*(batch.column(c).to_pylist() for c in ("start", "content", "places"))):
                out = []
                for place in places:
                    at = place["offset"] - start
                    found = read_record(zlib.decompress(content[at : at + place["length"]], _GZIP))
                    out.append(found if with_payload else found | {"payload": None})
                yield pa.RecordBatch.from_pylist(out, _READ_ARROW)

    return run


def read_records(archives: DataFrame, index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records that ``index`` names, each from its own gzip member: see :func:`read_record`.

    ``page_id`` and ``refers_to`` are the pages of record ids made by
    :func:`write_monolithic`, null for other records.  A subset of the index
    reads that subset only.
    """
    places = index.groupBy("archive", "part").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    rows = archives.select("archive", "part", "start", "content").join(places, ["archive", "part"])
    return rows.mapInArrow(_reader(with_payload), _READ)
