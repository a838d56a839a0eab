import base64
import gzip
import hashlib
import io
import zipfile

import pytest

from grafloom.llm import warc

PAGES = "page_id long, url string, html string, sha string, n int"


@pytest.mark.parametrize("force64", [False, True])
def test_zip_round_trip(force64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, force64)
    z.add("a/b.bin", b"0123456789" * 100)
    z.add("é.txt", b"")
    z.close()
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as other:
        assert other.testzip() is None and other.read("a/b.bin") == b"0123456789" * 100
    r = warc.ZipReader(io.BytesIO(out.getvalue()))
    assert list(r.members) == ["a/b.bin", "é.txt"]
    m = r.locate("a/b.bin")
    assert r.range(m, 5, 7) == b"5678901"
    with pytest.raises(ValueError):
        r.range(m, 999, 2)


def test_reads_other_writers_and_refuses_what_it_cannot():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"hello")
        z.writestr("y", b"hello" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"note PK"
    r = warc.ZipReader(io.BytesIO(out.getvalue()))
    assert r.range(r.locate("x"), 1, 3) == b"ell"
    with pytest.raises(ValueError):
        r.locate("y")
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(b"nothing"))
    with pytest.raises(ValueError):
        warc.ZipReader(io.BytesIO(out.getvalue()[40:]))


def test_record_parses():
    raw = gzip.decompress(gzip.compress(warc.record("http://x/\r\nEvil: 1", 4, "é\r\n\r\nb".encode(), "S", None)))
    fields, block = warc.parse(raw)
    assert fields["warc-type"] == "response" and "evil" not in fields
    assert block.partition(b"\r\n\r\n")[2] == "é\r\n\r\nb".encode()


def brute(rows, least):
    keep = {}
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        if page is not None and len(p) >= least:
            keep[p] = max(keep.get(p, page), page)
    out = []
    for page, _, html, *_ in rows:
        p = (html or "").encode()
        to = keep.get(p) if page is not None and keep.get(p, page) > page else None
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if to is not None else "response", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_archive_against_brute_force(spark, least):
    rows = [(1, "http://a", "same", "", 0), (2, None, "same", "", 0), (3, "http://b", None, "", 0), (4, "http://c", "", "", 0), (5, "u", "é" * 10, "", 0), (6, "u", "same", "", 0), (None, "u", "same", "", 0), (7, "u", "x" * 300000, "", 0), (7, "u", "x" * 300000, "", 0)]
    got = warc.archive(spark.createDataFrame(rows, PAGES).repartition(3), least)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == brute(rows, least)
    full = {r.page_id: r.payload for r in got.collect() if r.record_type == "response" and r.page_id}
    assert bytes(full[7]) == b"x" * 300000


def test_nothing(spark):
    assert warc.archive(spark.createDataFrame([], PAGES)).count() == 0
