"""Archives that other programs wrote: record types, missing fields, bounded inflation."""

import gzip
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arealis.llm import warc

PARTS = "archive string, part int, content binary"
BODY = b"<html>\r\n\r\n<p>caf\xc3\xa9</p></html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + BODY


def record(kind, name, block, *fields):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + name + b">", *fields, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


RECORDS = [
    record(b"warcinfo", b"urn:uuid:1", b"software: x\r\n", b"Content-Type: application/warc-fields"),
    record(b"request", b"urn:uuid:2", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"content-type: application/http; msgtype=request", b"WARC-Target-URI: http://a/"),
    record(b"response", b"urn:uuid:3", HTTP, b"Content-Type: application/http; msgtype=response", b"WARC-Target-URI: http://a/?q=1:2"),
    record(b"response", b"urn:uuid:4", HTTP, b"Content-Type: application/http;msgtype=response", b"WARC-Payload-Digest: sha1:" + warc.digest_of(BODY).encode()),
    record(b"response", b"urn:uuid:5", HTTP, b"Content-Type: application/http", b"WARC-Payload-Digest: SHA1:" + warc.digest_of(b"other").encode()),
    record(b"resource", b"urn:page:17", BODY, b"Content-Type: text/html", b"WARC-Payload-Digest: sha256:abc"),
    record(b"revisit", b"urn:uuid:6", b"", b"WARC-Refers-To: <urn:uuid:4>", b"WARC-Payload-Digest: sha1:XYZ"),
    record(b"metadata", b"urn:page:x", b""),
]


def parts(data, name="a", size=97):
    return [(name, i, bytearray(data[at : at + size])) for i, at in enumerate(range(0, len(data), size))]


@pytest.mark.parametrize("layout", ["one stream", "a member a record", "padded", "two streams"])
def test_records_of_any_origin(spark, layout):
    data = {
        "one stream": gzip.compress(b"".join(RECORDS)),
        "a member a record": b"".join(map(gzip.compress, RECORDS)),
        "padded": gzip.compress(b"".join(RECORDS)) + b"\0" * 300,
        "two streams": gzip.compress(b"".join(RECORDS)[:700]) + gzip.compress(b"".join(RECORDS)[700:]),
    }[layout]
    rows = parts(data) + parts(gzip.compress(RECORDS[2]), "b")
    stored, index = warc.normalise(spark.createDataFrame(rows, PARTS).repartition(3))
    found = warc.read_records(stored, index).collect()
    assert len(found) == len(RECORDS) + 1 and [r.record_id for r in found].count("urn:uuid:3") == 2
    got = {r.record_id: r for r in found}
    assert [got[f"urn:uuid:{i}"].record_type for i in range(1, 7)] == ["warcinfo", "request", "response", "response", "response", "revisit"]
    for name in ("urn:uuid:3", "urn:uuid:4", "urn:uuid:5", "urn:page:17"):
        assert bytes(got[name].payload) == BODY and got[name].payload_bytes == len(BODY)
    assert got["urn:uuid:3"].payload_digest == warc.digest_of(BODY) and got["urn:uuid:3"].target_uri == "http://a/?q=1:2"
    assert [got[n].digest_matches for n in ("urn:uuid:3", "urn:uuid:4", "urn:uuid:5", "urn:page:17", "urn:uuid:6")] == [None, True, False, None, None]
    assert (got["urn:page:17"].page_id, got["urn:page:17"].payload_digest) == (17, "sha256:abc") and got["urn:page:x"].page_id is None
    revisit = got["urn:uuid:6"]
    assert (revisit.refers_to_id, revisit.refers_to, revisit.payload, revisit.payload_bytes, revisit.payload_digest) == ("urn:uuid:4", None, None, None, "XYZ")
    assert bytes(got["urn:uuid:1"].payload) == b"software: x\r\n" and got["urn:uuid:2"].payload_bytes == 0


def test_a_record_without_a_length_is_named(spark):
    bad = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\n\r\nbody\r\n\r\n"
    with pytest.raises(Exception, match="urn:uuid:9.*length"):
        warc.normalise(spark.createDataFrame(parts(gzip.compress(bad)), PARTS))


def test_a_part_is_inflated_a_few_megabytes_at_a_time(monkeypatch):
    """60 MB of one byte are some 60 kB of gzip, in one part."""
    big = record(b"resource", b"urn:uuid:1", b"x" * 60_000_000)
    pieces = []

    class Seen(warc._Records):
        def feed(self, piece):
            pieces.append(len(piece))
            return super().feed(piece)

    monkeypatch.setattr(warc, "_Records", Seen)
    batch = pa.RecordBatch.from_pylist([{"archive": "a", "part": 0, "content": zlib.compress(big, 9, 31)}])
    out = list(warc._normaliser(1 << 20, 1)(iter([batch])))
    assert max(pieces) <= warc.INFLATE_BYTES and sum(pieces) == len(big)
    assert sum(len(m) for b in out for m in b.column("members").to_pylist()) == 1


def test_every_archive_is_a_task_of_its_own(spark):
    rows = [r for k in range(20) for r in parts(gzip.compress(RECORDS[2] * 3), f"archive{k}", 50)]
    stored, index = warc.normalise(spark.createDataFrame(rows, PARTS))
    assert index.count() == 60 and index.groupBy("archive").count().where("count = 3").count() == 20
    assert warc.read_records(stored, index.where(F.col("archive") == "archive7")).count() == 3


def test_clashing_columns_and_repeated_pages(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "v", "a"), (2, "v", "b"), (3, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.select("*", *[F.lit("kept").alias(c) for c in "payload digest sha1 first refers_to archive part content".split()])
    stored, index = warc.normalise(warc.write_monolithic(pages))
    got = sorted((r.page_id, r.record_type, r.refers_to or 0) for r in warc.read_records(stored, index, with_payload=False).collect())
    assert got == [(1, "response", 0), (1, "response", 0), (2, "response", 0), (2, "revisit", 1), (3, "response", 0)]
