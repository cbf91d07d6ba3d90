import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from leafaudit.llm import warc
from leafaudit.session import scratch_path

LONG = "<p>\r\n\r\nWARC/1.1\r\n</p>" * 200_000
PAGES = [
    (1, "http://a.example/ x", "<p>one</p>"), (2, "http://b.example/", "<p>two</p>"), (3, None, "<p>one</p>"), (None, "u", "<p>one</p>"), (None, "u", "<p>alone</p>"),
    (4, "u", None), (5, "u", ""), (6, "u", LONG), (7, "u", "\r\n\r\nHTTP/1.0 é😀\x00"), (2, "http://b.example/", "<p>two</p>"), (8, "u", LONG),
] + [(100 + i, "u", "hot") for i in range(40)]


def expected(pages):
    last, out = {}, []
    for i, _, h in pages:
        h = h or ""
        last[h] = max(last.get(h, -1), -1 if i is None else i)
    done = set()
    for i, _, h in pages:
        h = h or ""
        first = (-1 if i is None else i) == last[h] and h not in done
        done |= {h} if first else set()
        digest = base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        out.append((i, len(h.encode()), digest, "response" if first else "revisit", None if first else last[h]))
    return sorted(out, key=str)


def folder(spark, label):
    return scratch_path(spark, label)


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_round_trip_through_both_versions(spark, archive_bytes):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, record_type string, block string").repartition(3)
    legacy, archives = folder(spark, "t-arc"), folder(spark, "t-warc")
    warc.write_arc(pages, legacy, archive_bytes=archive_bytes)
    warc.convert_arc(spark, legacy, archives, archive_bytes=archive_bytes)
    found = warc.read_warc(spark, archives)
    records = [r for r in found.collect() if r.record_type != "warcinfo"]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str) == expected(PAGES)
    by_id = {r.record_id: r for r in records}
    assert len(by_id) == len(PAGES)
    texts = {h or "" for _, _, h in PAGES}
    for r in records:
        if r.record_type == "revisit":
            to = by_id[r.refers_to_record]
            assert (to.record_type, to.payload_digest, to.page_id) == ("response", r.payload_digest, r.refers_to) and r.payload is None
        else:
            assert bytes(r.payload).decode() in texts
        assert r.date == "2024-01-01T00:00:00Z" and " " not in r.target_uri
    assert {bytes(r.content)[:2] for r in warc.archive_files(spark, archives).collect()} == {b"\x1f\x8b"}


def test_archives_are_plain_gzip_members(spark):
    legacy = folder(spark, "t-arc")
    warc.write_arc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), legacy, versions=(2,), archive_bytes=300)
    files = [bytes(r.content) for r in warc.archive_files(spark, legacy).collect()]
    assert len(files) > 3
    for data in files:
        assert gzip.decompress(data).startswith(b"filedesc://")
        assert b"\n2 0 leafaudit\nURL IP-address Archive-date Content-type Result-code" in gzip.decompress(data)


def test_least_bytes_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    legacy, archives = folder(spark, "t-arc"), folder(spark, "t-warc")
    warc.write_arc(pages, legacy)
    warc.convert_arc(spark, legacy, archives, least_bytes=3)
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_warc(spark, archives).collect() if r.page_id) == [(1, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None)]
    legacy, archives = folder(spark, "t-arc"), folder(spark, "t-warc")
    warc.write_arc(pages.limit(0), legacy)
    warc.convert_arc(spark, legacy, archives)
    assert warc.read_warc(spark, archives).count() == 0


def parse(data):
    return list(warc.pieces(data, warc.ArcReader()))


def test_header_lines_of_either_version_compressed_or_not():
    v1 = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain 76\n1 0 Alexa Internet\nURL IP-address Archive-date Content-type Archive-length\n\n"
    body = b"HTTP/1.0 200 Document follows\nno blank line"
    record = b"http://www.dryswamp.edu:80/a b.html 127.10.100.2 19961104142103 text/html %d\n" % len(body) + body + b"\n"
    for data in (v1 + record * 2, gzip.compress(v1 + record * 2), gzip.compress(v1) + gzip.compress(record) * 2):
        first, *rest = parse(data)
        assert first[1]["first"] and len(rest) == 2 and rest[0][0] != rest[1][0]
        for _, fields, block in rest:
            assert fields["URL"] == "http://www.dryswamp.edu:80/a b.html" and fields["Archive-date"] == "19961104142103" and block == body
    v2 = warc.version_block(2, "y.arc", "19970101000000") + warc.arc_record(2, "dns:x", "1997010100", "text/dns", b"\n1 2\n", 9, "y.arc")
    _, (_, fields, block) = parse(v2)
    assert (fields["Result-code"], fields["Offset"], fields["Checksum"], block) == ("200", "9", hashlib.md5(b"\n1 2\n").hexdigest(), b"\n1 2\n")
    assert warc.iso_date("1997010100") == "1997-01-01T00:00:00Z" and warc.iso_date("1996") == "1996-01-01T00:00:00Z"


@pytest.mark.parametrize("data", [b"filedesc://x 0.0.0.0 1 text/plain 3\n9 0\n", b"u 0.0.0.0 1996 text/html 50\nshort", b"u 1996 5\nabcde", gzip.compress(b"x" * 99)[:20]])
def test_damaged_archives_are_not_passed_over(data):
    with pytest.raises(ValueError):
        parse(data)


def test_resources_and_foreign_archives(spark, tmp_path):
    """An archive from elsewhere: no page ids, a DNS record, no Content-Length of its own."""
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nsame"
    data = warc.version_block(1, "f.arc", "20000101000000") + b"".join(warc.arc_record(1, u, "20010203040506", k, b, 0, "f.arc") for u, k, b in [("dns:x", "text/dns", b"1.2.3.4"), ("http://x/1", "text/html", page), ("http://x/2", "text/html", page)])
    (tmp_path / "f.arc").write_bytes(data)
    archives = folder(spark, "t-warc")
    warc.convert_arc(spark, str(tmp_path), archives)
    got = [(r.record_type, r.target_uri, r.payload_bytes, r.date) for r in warc.read_warc(spark, archives).filter(F.col("record_type") != "warcinfo").collect()]
    assert sorted(got) == [("resource", "dns:x", 7, "2001-02-03T04:05:06Z"), ("response", "http://x/2", 4, "2001-02-03T04:05:06Z"), ("revisit", "http://x/1", 4, "2001-02-03T04:05:06Z")]
