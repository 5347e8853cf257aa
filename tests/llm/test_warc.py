import hashlib
import io
import zipfile

import pytest

from marklens.llm import warc, zipread
from marklens.session import scratch_dir

BIG = "<p>" + "x" * 1200


def _pages(spark):
    rows = [(k, f"http://a.example/{k}?q=1 2", BIG) for k in range(1, 31)]
    rows += [(100, None, None), (101, "", ""), (102, "http://b.example/\r\nWARC-Type: x", "short"), (103, "http://[bad", "short"), (104, "http://é.example/ü", "é\r\n\r\n\x00" * 400)]
    rows += [(None, "http://n.example/", BIG), (200, "u", "y" * 999), (201, "u", "y" * 999), (202, "u", "y" * 1000), (203, "u", "y" * 1000)]
    rows += [(203, "u", "y" * 1000), (None, "m", "z" * 2000), (None, "m", "z" * 2000), (-5, "neg", "w" * 300000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS keeper", "3 AS payload", "4 AS page"), rows


def _want(rows):
    first = {}
    for page, _, html in rows:
        if html and len(html.encode()) >= 1000 and page is not None:
            first[html] = max(first.get(html, page), page)
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = html in first and (page is None or page < first[html])
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=repr)


def _got(table):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in table.collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"zip64": True}, {"index": False}])
def test_round_trip(spark, options, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 4000)
    monkeypatch.setattr(warc, "PACKAGE_BYTES", 12000)
    monkeypatch.setattr(warc, "INDEX_BLOCK", 500)
    pages, rows = _pages(spark)
    assert _got(warc.archive_pages(spark, pages.repartition(3), **options)) == _want(rows)


def test_real_pages_and_payloads(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    packages = warc.write(pages, f"{scratch_dir(spark)}/real-pages")
    found = warc.records(packages).toPandas()
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    assert len(found) == len(want) == packages.agg({"records": "sum"}).first()[0]
    assert {int(r.record_id[len(warc.ID_PREFIX):]): bytes(r.payload) for r in found.itertuples()} == want
    name = packages.first().package
    with zipfile.ZipFile(name.removeprefix("file://")) as z:  # any other reader takes them too
        assert z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(spark, pages).collect() == []


def _zip(n=3, comment=b"", before=b"", zip64=False, method=zipfile.ZIP_STORED):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", method) as z:
        for k in range(n):
            with z.open(zipfile.ZipInfo(f"archive/ü{k}"), "w", force_zip64=zip64) as out:
                out.write(bytes([k % 256]) * (k % 300 + 1))
        z.comment = comment
    return before + sink.getvalue()


@pytest.mark.parametrize("options", [{}, {"comment": b"PK\x05\x06 no end" * 3}, {"before": b"#!/bin/sh\n" * 10}, {"zip64": True}, {"n": 0}, {"n": 70000}])
def test_directories(options):
    data = _zip(**options)
    f = io.BytesIO(data)
    found = list(zipread.members(f, len(data)))
    assert [m.name for m in found] == [f"archive/ü{k}" for k in range(options.get("n", 3))]
    for k, m in list(enumerate(found))[:300]:
        start = zipread.data_start(f, m)
        assert data[start : start + m.packed] == bytes([k % 256]) * (k % 300 + 1)


def test_zip64_places_beyond_four_gigabytes():
    # a directory written by hand: sizes and places only in the ZIP64 fields
    import struct

    extra = struct.pack("<2H3Q", 1, 24, 5 << 32, 6 << 32, 7 << 32)
    entry = struct.pack("<4s6H3L5H2L", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + b"a" + extra
    record = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, len(entry), 1)
    data = entry + record + locator + struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (m,) = zipread.members(io.BytesIO(data), len(data))
    assert (m.size, m.packed, m.header) == (5 << 32, 6 << 32, 7 << 32)


@pytest.mark.parametrize("data", [b"", b"PK", _zip()[:-1], b"x" * 100])
def test_broken_packages_are_refused(data):
    with pytest.raises(ValueError):
        list(zipread.members(io.BytesIO(data), len(data)))


def test_foreign_package_with_compressed_index_and_plain_archive(spark, tmp_path):
    import gzip

    block = b"HTTP/1.1 200 OK\r\n\r\nbody"
    plain = b"".join(
        b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % (kind, k, len(block)) + block + b"\r\n\r\n"
        for k, kind in enumerate((b"request", b"response", b"response"))
    )
    cut = plain.index(b"WARC/1.0", 10)
    line = b'com,a)/ 2020 {"filename": "p.warc", "offset": "%d", "length": "%d"}\n' % (cut, (len(plain) * 2) // 3)
    for name, index in (("walked.wacz", False), ("told.wacz", True)):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("archive/p.warc", plain)
            if index:
                z.writestr(zipfile.ZipInfo("indexes/index.cdx.gz"), gzip.compress(b"!meta\n" + line[:40]) + gzip.compress(line[40:]))
    packages = spark.createDataFrame([(str(tmp_path / n),) for n in ("walked.wacz", "told.wacz")], "package string")
    got = sorted((r.package[-11:], r.record_id, bytes(r.payload)) for r in warc.records(packages).collect())
    assert got == [("/told.wacz"[-11:] if len("/told.wacz") > 11 else str(tmp_path / "told.wacz")[-11:], "urn:page:1", b"body"), ("walked.wacz", "urn:page:1", b"body"), ("walked.wacz", "urn:page:2", b"body")]


def test_digest_that_does_not_fit():
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nWARC-Payload-Digest: sha1:" + b"A" * 32 + b"\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(raw)
