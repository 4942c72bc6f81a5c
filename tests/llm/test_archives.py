"""Archives written and read back; ZIP directories of several kinds."""

import base64
import gzip
import hashlib
import io
import json
import zipfile
from collections import Counter

import duckdb
import pytest

from millrace.llm import queries, wacz


class Bytes:
    """A store's file in memory that counts what is read."""

    def __init__(self, raw):
        self.raw, self.count = raw, 0

    def read_at(self, n, at):
        self.count += n
        return self.raw[at : at + n]


def reader(raw):
    return wacz.PackageReader(Bytes(raw), len(raw))


def expected(rows, least=0):
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    out = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [k for k in groups[html or ""] if k is not None]
        refers = len(raw) >= least and len(groups[html or ""]) > 1 and ids and i != max(ids)
        out[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if refers else "response", max(ids) if refers else None] += 1
    return out


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "http://é/ x\n", "é\r\n\r\nb😀"),
    (None, "http://n", "<p>same</p>"), (6, "u", "big " * 50_000), (7, "v", "big " * 50_000), (-8, "w", "PK\x05\x06 looks like an end"), (10, "z", "WARC/1.1\r\n\r\n"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "page_id long, url string, html string, leader long, digest string").repartition(3)


@pytest.mark.parametrize("least,package", [(0, 1 << 30), (12, 300), (10**9, 1 << 30)])
def test_round_trip(spark, pages, tmp_path, least, package):
    manifest = wacz.write_archives(pages, f"file://{tmp_path}/w", least, package)
    found = wacz.read_archives(manifest).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(ROWS, least)
    for r in found:
        assert (r.payload is None) == (r.record_type == "revisit")
        if r.payload is not None:
            assert hashlib.sha1(bytes(r.payload)).digest() == base64.b32decode(r.payload_digest)
    assert manifest.agg({"records": "sum"}).first()[0] == len(ROWS)


def test_no_pages(spark, pages, tmp_path):
    manifest = wacz.write_archives(pages.limit(0), f"file://{tmp_path}/w")
    assert wacz.read_archives(manifest).collect() == []


def test_query_equals_sql(spark):
    found = queries.op7_warc(spark, "/root/testdata/sf0.001").collect()
    duckdb.sql("CREATE OR REPLACE VIEW pages AS SELECT * FROM '/root/testdata/sf0.001/pages.parquet'")
    result = duckdb.execute(queries.OP7_SQL)
    names = [d[0] for d in result.description]
    assert Counter(tuple(r[c] for c in names) for r in found) == Counter(result.fetchall())


def test_written_package_is_a_plain_zip(tmp_path):
    from pyarrow import fs

    package = wacz.Package(fs.LocalFileSystem(), str(tmp_path / "p.wacz"))
    for k in range(5):
        package.add("response", wacz.record(k, f"http://x/{k}", b"body %d" % k, False, None))
    path, records, _ = package.close()
    with zipfile.ZipFile(path) as found:
        assert found.testzip() is None and found.namelist() == [wacz.ARCHIVE, wacz.INDEX, wacz.ABOUT]
        raw = gzip.decompress(found.read(wacz.ARCHIVE))
        lines = found.read(wacz.INDEX).decode().splitlines()
        about = json.loads(found.read(wacz.ABOUT))
        assert all(hashlib.sha256(found.read(r["path"])).hexdigest() == r["hash"].removeprefix("sha256:") and len(found.read(r["path"])) == r["bytes"] for r in about["resources"])
    assert lines == sorted(lines) and all(line.startswith(f"x)/{k} 20240101000000 {{") for k, line in enumerate(lines))
    assert records == 5 and raw.count(b"WARC/1.1") == 5


def test_directories():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made:
        made.writestr("a.txt", b"first")
        with made.open("ünï.txt", "w", force_zip64=True) as member:
            member.write(b"second")
        made.writestr(zipfile.ZipInfo("c.gz"), b"third", zipfile.ZIP_DEFLATED)
        made.comment = b"a comment PK\x05\x06 with a false end"
    found = reader(out.getvalue())
    assert set(found.members) == {"a.txt", "ünï.txt", "c.gz"}
    at, n = found.place("ünï.txt")
    assert found.read(at, n) == b"second"
    with pytest.raises(ValueError):
        found.place("c.gz")
    for bad in (b"", b"not a zip at all", out.getvalue()[:-5]):
        with pytest.raises(ValueError):
            reader(bad)


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made:
        for k in range(4):
            with made.open(f"m{k}", "w", force_zip64=True) as member:
                member.write(b"payload %d" % k * 20)
    assert b"PK\x06\x06" in out.getvalue()
    found = reader(out.getvalue())
    for k in range(4):
        at, n = found.place(f"m{k}")
        assert found.read(at, n) == b"payload %d" % k * 20


def packed(first, n, compressed=True):
    """The bytes of an archive of n records, and where each lies."""
    raw, places = b"", []
    for k in range(first, first + n):
        one = wacz.record(k, f"http://h{k % 3}.example.com/p/{k}", b"%d" % k * (200 + k), False, None)
        one = gzip.compress(one, 0) if compressed else one
        places.append((len(raw), len(one)))
        raw += one
    return raw, places


def foreign(index="cdxj"):
    """A package by other tools: two archives, one of them not compressed, names of their own, several kinds of index."""
    (a, in_a), (b, in_b) = packed(0, 30), packed(100, 20, False)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made:
        made.writestr("datapackage.json", "{}")
        made.writestr("pages/pages.jsonl", "{}")
        made.writestr("archive/crawl-one.warc.gz", a)
        made.writestr("archive/sub/crawl-two.warc", b)
        places = [("crawl-one.warc.gz", p) for p in in_a] + [("crawl-two.warc", p) for p in in_b]
        if index == "cdxj":
            lines = [f'com,example)/{k} 20240101000000 {json.dumps({"url": "u", "offset": str(o), "length": str(n), "filename": f})}\n' for k, (f, (o, n)) in enumerate(places)]
            made.writestr("indexes/some.cdxj", "!meta {}\n" + "".join(sorted(lines)))
        if index == "cdx":
            lines = [f"com,example)/{k} 20240101000000 http://u text/html 200 SHA - - {n} {o} {f}\n" for k, (f, (o, n)) in enumerate(places)]
            made.writestr("indexes/some.cdx.gz", gzip.compress((" CDX N b a m s k r M S V g\n" + "".join(lines)).encode()))
    return out.getvalue(), {"archive/crawl-one.warc.gz": in_a, "archive/sub/crawl-two.warc": in_b}


@pytest.mark.parametrize("index", ["cdxj", "cdx", "none"])
@pytest.mark.parametrize("most", [wacz.RANGE_BYTES, 1000])
def test_packages_by_other_tools(monkeypatch, index, most):
    monkeypatch.setattr(wacz, "RANGE_BYTES", most)
    raw, places = foreign(index)
    found = reader(raw)
    assert found.index() == places
    ids = [wacz._found(r, False)[0] for name, some in places.items() for r in found.records(name, some)]
    assert ids == [*range(30), *range(100, 120)]


def test_packages_by_other_tools_are_read(spark, tmp_path):
    (tmp_path / "other.wacz").write_bytes(foreign()[0])
    found = wacz.read_archives(spark.createDataFrame([(f"file://{tmp_path}/other.wacz",)], "path string")).collect()
    assert {r.page_id: bytes(r.payload) for r in found} == {k: b"%d" % k * (200 + k) for k in [*range(30), *range(100, 120)]}


def test_each_index_is_read_once(monkeypatch, spark, tmp_path, pages):
    manifest = wacz.write_archives(pages, f"file://{tmp_path}/w")
    slices = wacz.slices_of(manifest, 2).collect()
    assert sum(len(r.offsets) for r in slices) == len(ROWS) and max(len(r.offsets) for r in slices) == 2
    monkeypatch.setattr(wacz.PackageReader, "index", None)  # reading slices needs none
    raw = open(slices[0].path.removeprefix("file:"), "rb").read()
    assert len(list(reader(raw).records(slices[0].archive, list(zip(slices[0].offsets, slices[0].lengths))))) == len(slices[0].offsets)


@pytest.mark.parametrize("url,key", [("http://www.Example.com:8080/A?b=C#d", "com,example:8080)/a?b=c"), ("https://example.com", "com,example)/"), ("urn:page:5", "urn:page:5"), ("http://u@h.org:80/x", "org,h)/x")])
def test_sort_keys(url, key):
    assert wacz.sort_key(url) == key


def test_hot_payloads_are_split(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(wacz, "HOT_PAGES", 3)
    rows = [(k, f"http://a/{k}", "same" if k % 2 else f"own {k}") for k in range(40)]
    manifest = wacz.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    found = wacz.read_archives(manifest).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found) == expected(rows)


def test_records_are_read_by_ranges():
    entries, raw = [], b""
    for k in range(200):
        packed = gzip.compress(wacz.record(k, "u", b"%d" % k * 3000, False, None), 0)
        entries.append((len(raw), len(packed)))
        raw += packed
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as made:
        made.writestr(wacz.ARCHIVE, raw)
        made.writestr(wacz.INDEX, "")
    source = Bytes(out.getvalue())
    found = wacz.PackageReader(source, len(source.raw))
    before = source.count
    assert [wacz.parse_record(r)[2] for r in found.records(wacz.ARCHIVE, entries[50:53])] == [b"%d" % k * 3000 for k in (50, 51, 52)]
    assert source.count - before < sum(n for _, n in entries[50:53]) + 100
