"""WARC archives against plain reading of the files, the SQL twin and hand-made cases."""

import gzip
import hashlib
import io
import zlib

import pytest

from labframe.llm import warc
from labframe.llm.common import new_path

LONG = "<html>" + "x" * 200
PAGES = [
    (3, "https://a.example/1", LONG), (1, "https://a.example/2", LONG), (7, None, LONG), (None, "https://a.example/null", LONG),
    (4, "https://a.example/4", "short"), (5, "https://a.example/5", "short"), (6, "https://a.example/6\r\nX: y", None), (8, "", ""),
    (9, "https://a.example/9", "a\r\n\r\nb\r\n\r\n\r\n\r\n" + "é" * 80), (10, "https://a.example/10", "\r\n" * 70), (11, "https://a.example/11", "WARC/1.1\r\n\r\nWARC/1.1\r\n\r\r\n\r"),
    (12, "https://a.example/12", "é" * 50), (13, "https://a.example/13", "é" * 50), (2, "https://a.example/2", "y" * 99), (14, "https://a.example/14", "y" * 99), (15, "u", "z" * 3_000_000), (16, "u", LONG.upper()), (16, "u", LONG.upper()),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "keeps out", 1) for p in PAGES]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, record_type string, length int").repartition(3)


def wanted(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        at = first.get(html)
        again = at is not None and at != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", at if again else None))
    return sorted(out, key=repr)


def test_records_come_back_from_normalised_archives(pages):
    assert sorted(map(tuple, warc.archived(pages).collect()), key=repr) == wanted(PAGES)
    assert warc.archived(pages.where("page_id < 0")).count() == 0
    assert sorted(map(tuple, warc.archived(pages.unionByName(pages)).collect()), key=repr) == wanted(PAGES * 2)


def test_every_record_is_a_member_at_its_offset(spark, pages):
    whole, single = new_path(spark, "whole"), new_path(spark, "single")
    warc.write_archives(pages, whole)
    sources = [r.path for r in spark.read.format("binaryFile").load(whole).select("path").collect()]
    plain = b"".join(gzip.decompress(open(p.removeprefix("file:"), "rb").read()) for p in sources)
    monolithic = zlib.decompressobj(31)
    assert monolithic.decompress(open(sources[0].removeprefix("file:"), "rb").read()) and monolithic.eof and not monolithic.unused_data
    index = warc.normalised(spark, whole, single)
    rows = index.collect()
    assert len(rows) == len(PAGES) and len({(r.file, r.offset) for r in rows}) == len(PAGES)
    members = {}
    for r in rows:
        with open(r.file.removeprefix("file:").replace("//", "/"), "rb") as f:
            f.seek(r.offset)
            one = zlib.decompressobj(31)
            members[r.file, r.offset] = one.decompress(f.read(r.length))
            assert one.eof and not one.unused_data
    assert sorted(b"".join(members[k] for k in sorted(members))) == sorted(plain)
    # a normalised archive is an archive: gzip reads it whole, and it can be normalised again
    for file in {r.file for r in rows}:
        path = file.removeprefix("file:").replace("//", "/")
        assert gzip.decompress(open(path, "rb").read()) == b"".join(members[k] for k in sorted(members) if k[0] == file)
    again = warc.normalised(spark, single, new_path(spark, "again"))
    assert sorted(map(tuple, warc.records(again).collect()), key=repr) == sorted(map(tuple, warc.records(index).collect()), key=repr)


def test_payloads_and_revisits(spark, pages):
    whole = new_path(spark, "whole")
    warc.write_archives(pages, whole)
    found = warc.records(warc.normalised(spark, whole, new_path(spark, "single")), payload=True)
    bodies = {r.record_id: r.payload for r in found.collect()}
    assert bytes(bodies["urn:page:9"]).decode() == PAGES[8][2] and bytes(bodies["urn:page:6"]) == b"" and bodies["urn:page:7"] is None
    assert warc.dangling(found).count() == 0
    assert {r.record_id for r in warc.dangling(found.where("record_id <> 'urn:page:1'")).collect()} == {"urn:page:3", "urn:page:7", warc.NO_ID}


def record(kind="response", body=b"hello", digest=None, length=None):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = digest or hashlib.sha256(body).hexdigest()
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Payload-Digest: sha256:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {length or len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("data", [record(length=400), b"no archive\r\n\r\n", record(digest="0" * 64), record() + record()[:90], record(length=10)])
def test_broken_archives_fail(spark, tmp_path, data):
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="record"):
        warc.records(warc.normalised(spark, str(tmp_path), new_path(spark, "single"))).collect()


def test_foreign_archives_of_one_stream_or_plain(spark, tmp_path):
    data = record() + record("warcinfo", b"software: x\r\n") + record(body=b"\r\n\r\n" * 5)
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(data)
    (tmp_path / "b.warc").write_bytes(data)
    found = warc.records(warc.normalised(spark, str(tmp_path), new_path(spark, "single"))).collect()
    assert sorted((r.record_type, r.payload_bytes) for r in found) == sorted([("response", 5), ("warcinfo", 13), ("response", 20)] * 2)


@pytest.mark.parametrize("sizes", [1, 2, 3, 7, 100_000])
def test_cutter_gives_the_same_records_for_any_pieces(sizes):
    data = record() + record(body=b"") + record(body=b"a\r\n\r\n")
    cutter, got, source = warc.Cutter(), [], io.BytesIO(data)
    while piece := source.read(sizes):
        got += [r for r, _ in cutter.feed(piece)]
    cutter.end("x")
    assert b"".join(got) == data and len(got) == 3
