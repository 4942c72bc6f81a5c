"""WARC records in ZIP packages: a writer, and a reader that finds records by ranges without unpacking.

Each package that is written stores, uncompressed as ZIP members, one WARC file of singly gzipped records, a CDXJ
index of them sorted by key and time, and a description with the members' sizes and hashes. The reader takes any such
package: it fetches the tail, follows the end record (and its ZIP64 form) to the central directory, locates the stored
archives and indexes, whatever they are called and however many there are, and reads each index once. Slices of
records that lie near each other then go to tasks, which read only the byte ranges of theirs. Where no index names an
archive's records, their places are found by walking through it.

Equal payloads are stored once: the record of the largest page id is the response, the others revisit it.

Defined results: a null payload is empty; pages that tie at the largest id of a payload are all responses; a null
page id revisits like any other, and where a payload has null ids only, all are responses; a null url becomes a
urn; an empty table gives no packages and an empty reading; other columns aren't read. Records of other kinds than
response and revisit are read with their whole block as payload. The payloads are shuffled once by their digest, those
of a hot digest by several keys; tasks hold one record, and one package's index while it is read or written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hot_join, text_of, written

#: Where a package that is written has its members.
ARCHIVE, INDEX, ABOUT = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: What archives and indexes are called in any package.
ARCHIVES, INDEXES = re.compile(r"\.warc(\.gz)?$", re.IGNORECASE), re.compile(r"\.cdxj?(\.gz)?$", re.IGNORECASE)
DATE = "2024-01-01T00:00:00Z"
#: A package is closed at this size; a range read fetches so much at most, or one record.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Records that one reading task takes from a package; pages of one payload that one task joins with their leader.
SLICE, HOT_PAGES = 2000, 8192


def open_store(uri: str):
    """(file system, path) of a folder or file that driver and executors share."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<?urn:page:(-?\d+)>?", urn or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, refers: bool, leader: int | None, date: str = DATE) -> bytes:
    """A response record, or where refers is true a revisit of the leader's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else _urn(page)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers else 'response'}",
        f"WARC-Record-ID: <{_urn(page)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(body)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers:
        lines[2:2] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_urn(leader)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def sort_key(url: str) -> str:
    """The key that indexes sort urls by: the host's names from the last to the first, then port, path and query."""
    found = re.fullmatch(r"https?://(?:[^/@]*@)?([^/:?#]+)(?::(\d+))?([^#]*).*", url, re.IGNORECASE | re.DOTALL)
    if not found:
        return re.sub(r"\s", "%20", url) or "-"
    host = ",".join(reversed(re.sub(r"^www\d*\.", "", found[1].lower()).split(".")))
    port = f":{found[2]}" if found[2] and found[2] not in ("80", "443") else ""
    return re.sub(r"\s", "%20", f"{host}{port}){found[3].lower() or '/'}")


class Package:
    """One ZIP package being written; the archive streams out, the index is kept until it ends."""

    def __init__(self, store, path: str):
        self.store, self.path, self.index, self.size, self.hash = store, path, [], 0, hashlib.sha256()
        self.out = store.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.archive = self.zip.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)

    def add(self, kind: str, raw: bytes) -> None:
        packed, fields = gzip.compress(raw, 3, mtime=0), parse_record(raw)[0]
        url = fields["warc-target-uri"]
        more = {"url": url, "mime": "warc/revisit" if kind == "revisit" else "text/html", "status": "200", "digest": fields["warc-payload-digest"], "length": str(len(packed)), "offset": str(self.size), "filename": ARCHIVE.rpartition("/")[2]}
        self.index.append(f"{sort_key(url)} {re.sub('[^0-9]', '', fields['warc-date'])[:14]} {json.dumps(more)}\n")
        self.archive.write(packed)
        self.hash.update(packed)
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.archive.close()
        index = "".join(sorted(self.index)).encode()
        members = ((ARCHIVE, self.size, self.hash.hexdigest()), (INDEX, len(index), hashlib.sha256(index).hexdigest()))
        about = {"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": path.rpartition("/")[2], "path": path, "bytes": n, "hash": f"sha256:{digest}"} for path, n, digest in members]}
        self.zip.writestr(zipfile.ZipInfo(INDEX), index)
        self.zip.writestr(zipfile.ZipInfo(ABOUT), json.dumps(about, indent=1))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.size


def with_leaders(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """page_id, url, html, leader and n_same: of pages with equal payloads of at least `least` bytes, the largest id."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(text_col).alias("html"))
    slim = slim.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("bytes", F.octet_length("html"))
    same = written(slim.where(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("leader"), F.count("*").alias("n_same")).where("n_same > 1"), "wacz-same")
    return hot_join(slim, same, ["digest"], "n_same", F.struct("page_id", "url"), HOT_PAGES, "left").select("page_id", "url", "html", "leader", "n_same")


def write_archives(pages: DataFrame, folder: str, least: int = 0, package_bytes: int = PACKAGE_BYTES, **columns: str) -> DataFrame:
    """Write packages of the pages to folder; gives their manifest (path, records, bytes).

    A package's name is new with each attempt, and the manifest is what committed tasks returned, so packages that
    a lost executor left behind are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        package, done = None, []
        for batch in batches:
            for block in blocks(batch, "html"):
                for page, url, html, leader, n_same in zip(*(block.column(c).to_pylist() for c in ("page_id", "url", "html", "leader", "n_same")), strict=True):
                    refers = n_same is not None and leader is not None and leader != page
                    if package is None:
                        package = Package(store, f"{base}/{uuid.uuid4().hex}.wacz")
                    package.add("revisit" if refers else "response", record(page, url, html.encode(), refers, leader))
                    if package.size >= package_bytes:
                        done.append(package.close())
                        package = None
        if package is not None:
            done.append(package.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["path", "records", "bytes"])

    return written(with_leaders(pages, least, **columns).mapInArrow(run, "path string, records long, bytes long"), "wacz-manifest")


@dataclass(frozen=True)
class Member:
    """A ZIP member: its method, size and where its local header begins."""

    method: int
    size: int
    header: int


class PackageReader:
    """Reads a ZIP package by ranges: the directory first, then parts of stored members."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        return self.source.read_at(n, at)

    def _directory(self) -> dict[str, Member]:
        tail_at = max(0, self.size - 65557)
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and end + 22 + int.from_bytes(tail[end + 20 : end + 22], "little") != len(tail):
            end = tail.rfind(b"PK\x05\x06", 0, end)
        if end < 0:
            raise ValueError("not a ZIP package: it has no end record")
        count, size, start = struct.unpack("<10xHII", tail[end : end + 20])
        if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self.read(tail_at + end - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            long_end = self.read(int.from_bytes(locator[8:16], "little"), 56)
            if long_end[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end record is missing")
            count, size, start = struct.unpack("<32xQQQ", long_end)
        raw, at, members = self.read(start, size), 0, {}
        for _ in range(count):
            sig, flags, method, packed, full, n_name, n_extra, n_note, header = struct.unpack("<4s4xHH8xIIHHH8xI", raw[at : at + 46])
            if sig != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            name = raw[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                tag, n = struct.unpack("<HH", extra[:4])
                if tag == 1:  # the 64-bit values, for those fields that are full, in this order
                    wide = iter(struct.unpack(f"<{n // 8}Q", extra[4 : 4 + n // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + n :]
            members[name] = Member(method, packed, header)
            at += 46 + n_name + n_extra + n_note
        return members

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and how many there are."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; ranges of it can't be read")
        head = self.read(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: its local header is damaged")
        n_name, n_extra = struct.unpack("<HH", head[26:30])
        return member.header + 30 + n_name + n_extra, member.size

    def archives(self) -> list[str]:
        return sorted(name for name in self.members if ARCHIVES.search(name))

    def index(self) -> dict[str, list[tuple[int, int]]]:
        """(offset, length) of each record of each archive, by offset; from the indexes, or by walking."""
        named, found = {name.rpartition("/")[2]: name for name in self.archives()}, {name: set() for name in self.archives()}
        for name in filter(INDEXES.search, self.members):
            raw = self.read(*self.place(name))
            for line in (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines():
                entry = _index_entry(line)
                if entry is None:
                    continue
                offset, length, file = entry
                archive = named.get(file.rpartition("/")[2]) if file else next(iter(found)) if len(found) == 1 else None
                if archive is None:
                    raise ValueError(f"{name} names {file or 'no archive'}, which the package doesn't hold")
                found[archive].add((offset, length))
        return {name: sorted(places) or list(self.walk(name)) for name, places in found.items()}

    def walk(self, archive: str) -> Iterator[tuple[int, int]]:
        """(offset, length) of each record of an archive without an index, read from end to end in ranges."""
        base, size = self.place(archive)
        at, held, start = 0, b"", 0  # held: what is read from start on
        while start < size:
            if len(held) < 2 and at < size:
                more = self.read(base + at, min(RANGE_BYTES, size - at))
                at, held = at + len(more), held + more
                continue
            length = 0
            if held[:2] == b"\x1f\x8b":
                unpacker = zlib.decompressobj(31)
                chunk = held
                while True:
                    unpacker.decompress(chunk)
                    if unpacker.eof:
                        length += len(chunk) - len(unpacker.unused_data)
                        break
                    length += len(chunk)
                    if at >= size:
                        raise ValueError(f"{archive} ends within a record")
                    chunk = self.read(base + at, min(RANGE_BYTES, size - at))
                    at, held = at + len(chunk), held + chunk
            else:
                while b"\r\n\r\n" not in held:
                    if at >= size:
                        raise ValueError(f"{archive} ends within a record")
                    more = self.read(base + at, min(RANGE_BYTES, size - at))
                    at, held = at + len(more), held + more
                head = held.partition(b"\r\n\r\n")[0]
                length = len(head) + 8 + int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", head)[1])
            yield start, length
            start += length
            held = held[length:] if length <= len(held) else b""
            at = max(at, start)

    def records(self, archive: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
        """The raw records at some places of an archive, by offset; neighbours are fetched in one range."""
        base, _ = self.place(archive)
        k = 0
        while k < len(places):
            last, first = k, places[k][0]
            while last + 1 < len(places) and places[last + 1][0] == sum(places[last]) and sum(places[last + 1]) - first <= RANGE_BYTES:
                last += 1
            raw = self.read(base + first, sum(places[last]) - first)
            for offset, length in places[k : last + 1]:
                part = raw[offset - first : offset - first + length]
                yield gzip.decompress(part) if part[:2] == b"\x1f\x8b" else part
            k = last + 1


def _index_entry(line: str) -> tuple[int, int, str] | None:
    """Offset, length and file of a line of an index: JSON after key and time, or the fields of the older form."""
    key, _, rest = line.partition(" ")
    if not rest or key in ("CDX", "!meta") or line.startswith((" ", "!")):
        return None
    _, _, rest = rest.partition(" ")
    if rest.startswith("{"):
        more = json.loads(rest)
        return int(more["offset"]), int(more["length"]), more.get("filename", "")
    fields = rest.split(" ")
    return (int(fields[-2]), int(fields[-3]), fields[-1]) if len(fields) >= 9 else None


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""

    def fields(head: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    http, _, payload = rest[: int(warc["content-length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


RECORDS = "page_id long, record_id string, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _found(raw: bytes, payloads: bool) -> tuple:
    """A row of RECORDS."""
    warc, http, payload = parse_record(raw)
    kind = warc["warc-type"]
    if kind == "revisit":
        size, digest = int(http.get("content-length", 0)), warc.get("warc-payload-digest", "").partition(":")[2]
    else:
        if kind != "response":
            payload = raw.partition(b"\r\n\r\n")[2][: int(warc["content-length"])]
        size, digest = len(payload), sha1_base32(payload)
    named = warc.get("warc-record-id", "")
    return _page(named), named, warc.get("warc-target-uri"), kind, _page(warc.get("warc-refers-to")), size, digest, payload if payloads and kind != "revisit" else None


def slices_of(manifest: DataFrame, size: int = SLICE) -> DataFrame:
    """path, archive, offsets and lengths of at most `size` records that follow each other; each index is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    found = PackageReader(source, source.size()).index()
                rows = [(path, archive, [o for o, _ in some], [n for _, n in some]) for archive, places in found.items() for some in (places[k : k + size] for k in range(0, len(places), size))]
                kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "archive", "offsets", "lengths"])

    paths = manifest.select("path")
    return paths.repartition("path").mapInArrow(run, "path string, archive string, offsets array<long>, lengths array<long>")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the packages at a manifest's paths, read in slices of SLICE records.

    payload_bytes and payload_digest are those of the payload for responses, and what the headers say for revisits.
    """
    names = [f.split()[0] for f in RECORDS.split(", ")]
    slices = written(slices_of(manifest), "wacz-slices")
    tasks = slices.count()  # rows of slices are tiny: by their bytes, one task would read all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, archive, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "archive", "offsets", "lengths")), strict=True):
                store, name = open_store(path)
                with store.open_input_file(name) as source:
                    rows, held = [], 0
                    for raw in PackageReader(source, source.size()).records(archive, list(zip(offsets, lengths))):
                        rows.append(_found(raw, payloads))
                        held += rows[-1][5] if payloads else 0
                        if held >= RANGE_BYTES:
                            yield _batch(rows, names)
                            rows, held = [], 0
                    yield _batch(rows, names)

    return slices.repartition(max(1, tasks), "path", F.col("offsets")[0]).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
