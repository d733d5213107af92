import base64
import gzip
import hashlib
import json
import zipfile

import pytest

from sangloc.llm import zip_archives as za
from sangloc.llm.queries import op4_zip_warc


def expected(rows, least=0):
    first = {}
    for page, _, body in rows:
        data = (body or "").encode()
        if len(data) >= least and page is not None:
            first[data] = min(page, first.get(data, page))
    out = []
    for page, _, body in rows:
        data = (body or "").encode()
        to = first.get(data) if len(data) >= least and first.get(data) != page else None
        name = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), name, "response" if to is None else "revisit", to))
    return sorted(out, key=str)


ROWS = [(3, "http://a/", "<p>é</p>"), (1, "http://b/", "<p>é</p>"), (2, None, None), (5, "http://c/\r\nX: y", ""), (7, "http://d/", "x" * 200000), (8, "http://e/", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "http://f/", "x" * 200000)]


@pytest.mark.parametrize("least", [0, 1, 10])
def test_round_trip(spark, least):
    rows = ROWS + [(None, "http://n/", "<p>é</p>"), (None, "u", "only null"), (1, "http://b/", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string")
    got = sorted((tuple(r) for r in za.round_trip(pages, least_bytes=least).collect()), key=str)
    assert got == expected(rows, least)
    assert za.round_trip(pages.limit(0)).count() == 0


def test_several_archives_and_a_standard_reader(spark, monkeypatch, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    monkeypatch.setattr(za, "ARCHIVE_RECORDS", 3)
    writer = za.ArchiveWriter(str(tmp_path))
    for page, url, body in ROWS:
        writer.add(page, url, (body or "").encode(), None)
    path, count, _ = writer.close()
    assert count == len(ROWS)
    with zipfile.ZipFile(path) as other:
        assert other.testzip() is None
        data, lines = other.read(za.DATA), other.read(za.INDEX).decode().splitlines()
    for (page, url, body), line in zip(ROWS, lines):
        where = json.loads(line[line.index("{") :])
        record = za.parsed(gzip.decompress(data[where["offset"] : where["offset"] + where["length"]]))
        assert (record["page"], record["payload"]) == (page, (body or "").encode())
        assert record["url"] == (url if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))
    folder = tmp_path / "many"
    folder.mkdir()
    made = za.write_archives(pages, str(folder)).collect()
    assert sum(r.records for r in made) == len(ROWS)
    assert {str(p) for p in folder.iterdir()} == {r.path for r in made}


def build(tmp_path, comment=b"", method=zipfile.ZIP_STORED, index=True, wide=False, before_close=lambda: None):
    path = tmp_path / "made.wacz"
    records = [za.record_bytes(i, f"http://x/{i}", b"body %d " % i * 400, None)[0] for i in range(30)]
    packed = [gzip.compress(r) for r in records]
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("pages/pages.jsonl", "{}")
        with z.open(zipfile.ZipInfo("archive/one.warc.gz") if method == 0 else "archive/one.warc.gz", "w", force_zip64=wide) as f:
            f.write(b"".join(packed))
        at, lines = 0, []
        for i, p in enumerate(packed):
            lines.append(f"x {i} " + json.dumps({"offset": str(at), "length": str(len(p)), "filename": "one.warc.gz"}))
            at += len(p)
        if index:
            z.writestr("indexes/index.cdx", "\n".join(lines))
        z.comment = comment
        before_close()
    return str(path)


@pytest.mark.parametrize("kind", [{}, {"index": False}, {"wide": True}, {"comment": b"PK\5\6" + b"c" * 300}])
def test_foreign_archives(spark, tmp_path, kind):
    path = build(tmp_path, **kind)
    got = za.records_of(spark.createDataFrame([(path,)], "path string")).collect()
    assert sorted((r.page, bytes(r.payload)) for r in got) == [(i, b"body %d " % i * 400) for i in range(30)]


@pytest.mark.parametrize("packed", [True, False])
def test_partial_indexes_plain_files_and_records_of_others(spark, tmp_path, packed):
    """An index that names every third record, with a heading; one file has none; ids and types of another writer."""
    path = tmp_path / "others.wacz"
    own = [za.record_bytes(i, f"http://x/{i}", b"body %d" % i, None)[0] for i in range(10)]
    info = b"software: other\r\n"
    other = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:12-34>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)
    again = b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Refers-To: <urn:uuid:12-34>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    records = [other, *own, again]
    stored = [gzip.compress(r) if packed else r for r in records]
    ending = ".warc.gz" if packed else ".warc"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr(f"archive/one{ending}", b"".join(stored))
        z.writestr(f"archive/two{ending}", stored[3])
        lines, at = [" CDX N b a m s k r M S V g", "x 1 {}"], 0
        for i, r in enumerate(stored):
            if i % 3 == 1:
                lines.append(f"x {i} " + json.dumps({"offset": at, "length": len(r), "filename": f"archive/one{ending}"}))
            at += len(r)
        lines.append("x 9 " + json.dumps({"offset": 0, "length": 5, "filename": "elsewhere.warc.gz"}))
        z.writestr("indexes/index.cdxj", "\n".join(lines))
    got = za.records_of(spark.createDataFrame([(str(path),)], "path string")).collect()
    pages = sorted((r.page, bytes(r.payload)) for r in got if r.page is not None)
    assert pages == sorted([(i, b"body %d" % i) for i in range(10)] + [(2, b"body 2")])
    foreign = {r.record_id: (r.record_type, r.payload and bytes(r.payload), r.payload_bytes, r.refers_to, r.refers_to_id) for r in got if r.page is None}
    assert foreign == {"urn:uuid:12-34": ("warcinfo", info, len(info), None, None), "urn:uuid:5": ("revisit", None, None, None, "urn:uuid:12-34")}


def test_names_of_stores(tmp_path):
    assert za.opened(str(tmp_path))[1] == str(tmp_path) and za.opened("dbfs:/a/b")[1] == "/dbfs/a/b"


def test_zip64_directory(tmp_path, monkeypatch):
    """The limits of the ZIP writer lowered for the directory, so that it is a ZIP64 one for a small file."""

    def lower():
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)

    path = build(tmp_path, before_close=lower)
    content = open(path, "rb").read()
    assert za.END64 in content and za.LOCATOR64 in content
    archive = za.Archive(path)
    ranges = list(archive.ranges())
    assert len(ranges) == 30 and za.parsed(gzip.decompress(archive.read(*ranges[7])))["page"] == 7


def test_members_that_are_not_stored_and_broken_files(tmp_path):
    with pytest.raises(ValueError, match="not stored"):
        list(za.Archive(build(tmp_path, method=zipfile.ZIP_DEFLATED)).ranges())
    for content in (b"", b"PK", b"nothing" * 100, b"PK\5\6" + b"\0" * 10):
        (tmp_path / "broken").write_bytes(content)
        with pytest.raises(ValueError):
            list(za.Archive(str(tmp_path / "broken")).ranges())
    whole = open(build(tmp_path), "rb").read()
    (tmp_path / "cut").write_bytes(whole[40:])
    with pytest.raises(ValueError):
        list(za.Archive(str(tmp_path / "cut")).ranges())


def test_query_by_hand(spark, folder):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in op4_zip_warc(spark, folder).collect()), key=str) == expected(rows)
