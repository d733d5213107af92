"""WARC records in ZIP-packaged web archives, read in place.

An archive is a ZIP file with stored members: `archive/data.warc.gz`, a gzip member for each record, and
`indexes/index.cdxj`, a line for each record with its place in that file.

`write_archives`: each task streams its pages to archives in the shared folder and returns a row for each archive.  Only archives of
such rows are ever read; what a lost task left behind is in none of them.  Pages with equal payloads are found by
their SHA-1 first; the page with the smallest id is the response, the others are revisits without payload.

`records_of`: reads the end of an archive, the central directory (by the ZIP64 records where there are any), and from
it the places of the members; then the index, whose lines are dealt out to tasks by archive and range.  A task reads the
byte range of a record, and nothing is unpacked to disk.  What an index does not name of a record file is walked record by record, packed
(`.warc.gz`) or not (`.warc`).  Records of any writer and type are read; ids of others are kept as they stand.

Rows: a null payload is empty.  A page whose id is null, or repeated with an equal payload, is a record of its own: a response
where it has the smallest id, a revisit otherwise; null is smaller than no id.  A null url leaves out the
target.  Payloads of fewer than `least_bytes` bytes are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sangloc.llm.common import column_type, staged
from sangloc.operators.joins import dim_join
from sangloc.sources.sinks import shared_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: An archive is closed after so many bytes or records; its index lines are held until then.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 256 << 20, 100_000
#: Bytes of an archive that one task reads records from.
RANGE_BYTES = 16 << 20
RECORD_DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_ID = "urn:page:"
# Signatures and sizes of the ZIP format.
END, END_SIZE, END64, LOCATOR64, LOCATOR_SIZE, ENTRY, ENTRY_SIZE, LOCAL_SIZE = b"PK\5\6", 22, b"PK\6\6", b"PK\6\7", 20, b"PK\1\2", 46, 30
ALL16, ALL32 = 0xFFFF, 0xFFFFFFFF


# ---------------------------------------------------------------- writing


#: Names of stores as Hadoop has them, and as the reader of files here has them; others are the same.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path of a folder or file; `dbfs:/` is the mount of that name."""
    scheme, _, rest = uri.partition(":")
    if scheme == "dbfs":
        uri = "/dbfs/" + rest.lstrip("/")
    elif scheme in SCHEMES:
        uri = f"{SCHEMES[scheme]}:{rest}"
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, dict]:
    """One WARC record, and its line for the index."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    kind, name = "revisit" if revisit else "response", digest(payload)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{PAGE_ID}{'' if page is None else page}>"), ("WARC-Date", RECORD_DATE)]
    if url is not None:
        safe = "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)
        head.append(("WARC-Target-URI", safe))
    head.append(("WARC-Payload-Digest", f"sha1:{name}"))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{PAGE_ID}{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + b"\r\n\r\n", {"url": url, "mime": "warc/revisit" if revisit else "text/html", "digest": f"sha1:{name}"}


class ArchiveWriter:
    """One archive, written front to back."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = opened(self.path)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.lines: list[str] = []
        self.size = 0

    def add(self, page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        record, line = record_bytes(page, url, payload, refers_to)
        packed = gzip.compress(record, 4, mtime=0)
        self.data.write(packed)
        line |= {"offset": self.size, "length": len(packed), "filename": DATA.rpartition("/")[2]}
        self.lines.append(f"{'' if page is None else page} 20240101000000 {json.dumps(line)}\n")
        self.size += len(packed)

    @property
    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or len(self.lines) >= ARCHIVE_RECORDS

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
            for line in self.lines:
                index.write(line.encode())
        self.zip.close()
        self.stream.close()
        return self.path, len(self.lines), self.size


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> DataFrame:
    """(path, records, bytes) of the archives written for the pages; a staged table."""
    payload = F.coalesce(F.col(body).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), payload.alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    # Only the digests are shuffled; they meet in partial minima first.
    same = rows.where(F.length("body") >= least_bytes).groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    same = staged(same.where("n > 1 AND first IS NOT NULL").select("sha", "first"), "equal-payloads")
    rows = dim_join(rows, same, "sha")
    refers = F.when((F.length("body") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("first")), F.col("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, closed = None, []
        for batch in batches:
            for row in batch.to_pylist():
                writer = writer or ArchiveWriter(folder)
                writer.add(row["key"], row["url"], row["body"], row["refers"])
                if writer.full:
                    closed.append(writer.close())
                    writer = None
        if writer:
            closed.append(writer.close())
        columns = zip(*closed) if closed else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    made = rows.select("key", "url", "body", refers.alias("refers")).mapInArrow(write, "path string, records long, bytes long")
    return staged(made, "archives")


# ---------------------------------------------------------------- reading


@dataclass
class Member:
    name: str
    method: int
    start: int
    size: int


class Archive:
    """Members of a ZIP file, by range reads."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, start: int, size: int) -> bytes:
        if start < 0 or size < 0 or start + size > self.size:
            raise ValueError("a range outside of the archive")
        return self.file.read_at(size, start)

    def members(self) -> dict[str, Member]:
        start, size, count = self._directory()
        block, at, out = self.read(start, size), 0, {}
        for _ in range(count):
            if block[at : at + 4] != ENTRY:
                raise ValueError("no entry where the central directory has one")
            flags, method = struct.unpack_from("<HH", block, at + 8)
            packed, plain, n, extra, comment, disk = struct.unpack_from("<LLHHHH", block, at + 20)
            (local,) = struct.unpack_from("<L", block, at + 42)
            name = block[at + ENTRY_SIZE : at + ENTRY_SIZE + n].decode("utf-8" if flags & 0x800 else "cp437")
            packed, local = self._wide(block[at + ENTRY_SIZE + n : at + ENTRY_SIZE + n + extra], plain, packed, local)
            if flags & 1:
                raise ValueError(f"{name} is encrypted")
            out[name] = Member(name, method, local, packed)
            at += ENTRY_SIZE + n + extra + comment
        return out

    def _directory(self) -> tuple[int, int, int]:
        """Start, size and entries of the central directory."""
        tail_start = max(0, self.size - END_SIZE - ALL16)
        tail = self.read(tail_start, self.size - tail_start)
        at = len(tail) - END_SIZE
        # The comment behind the record may hold its signature: its length has to reach the end.
        while at >= 0 and not (tail[at : at + 4] == END and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] == len(tail)):
            at = tail.rfind(END, 0, at + 3) if at > 0 else -1
        if at < 0:
            raise ValueError("no end of a central directory")
        count, size, start = struct.unpack_from("<HLL", tail, at + 10)
        place = tail_start + at - LOCATOR_SIZE
        if place >= 0 and (locator := self.read(place, LOCATOR_SIZE))[:4] == LOCATOR64:
            (end64,) = struct.unpack_from("<Q", locator, 8)
            wide = self.read(end64, 56)
            if wide[:4] != END64:
                raise ValueError("no ZIP64 record where its locator points")
            count64, size64, start64 = struct.unpack_from("<QQQ", wide, 32)
            count, size, start = (b if a in (ALL16, ALL32) else a for a, b in ((count, count64), (size, size64), (start, start64)))
        return start, size, count

    @staticmethod
    def _wide(extra: bytes, plain: int, packed: int, local: int) -> tuple[int, int]:
        """Packed size and local header, from the ZIP64 field where the entry has no room."""
        at = 0
        while at + 4 <= len(extra):
            kind, size = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                at += 4
                for name, value in (("plain", plain), ("packed", packed), ("local", local)):
                    if value == ALL32:
                        (value,) = struct.unpack_from("<Q", extra, at)
                        at += 8
                    packed, local = (value if name == "packed" else packed), (value if name == "local" else local)
                break
            at += 4 + size
        return packed, local

    def content(self, member: Member) -> tuple[int, int]:
        """Where a stored member's bytes are."""
        if member.method != 0:
            raise ValueError(f"{member.name} is not stored")
        n, extra = struct.unpack_from("<HH", self.read(member.start, LOCAL_SIZE), 26)
        return member.start + LOCAL_SIZE + n + extra, member.size

    def ranges(self) -> Iterator[tuple[int, int]]:
        """(start, size) in this file of every record: those that an index names, and all others of the record files."""
        members = self.members()
        stores = {n.rpartition("/")[2]: m for n, m in members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
        indexes = [m for n, m in members.items() if n.startswith("indexes/") and n.endswith((".cdxj", ".cdx"))]
        starts = {n: self.content(m) for n, m in stores.items()}
        named: dict[str, set[tuple[int, int]]] = {n: set() for n in starts}
        for member in indexes:
            start, size = self.content(member)
            for line in self.read(start, size).decode().splitlines():
                where = _place(line)
                if where and where[0] in starts:
                    named[where[0]].add((starts[where[0]][0] + where[1], where[2]))
        for name, (start, size) in starts.items():
            walk = self._walk if name.endswith(".gz") else self._walk_plain
            at = start
            for begun, length in sorted(named[name]):
                yield from walk(at, begun - at)
                yield begun, length
                at = max(at, begun + length)
            yield from walk(at, start + size - at)

    def _walk(self, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """The gzip members of a part of a file."""
        at, end, begun, engine = start, start + size, start, zlib.decompressobj(31)
        while at < end:
            part = self.read(at, min(step, end - at))
            engine.decompress(part)
            if engine.eof:
                at += len(part) - len(engine.unused_data)
                yield begun, at - begun
                begun, engine = at, zlib.decompressobj(31)
            else:
                at += len(part)

    def _walk_plain(self, start: int, size: int, step: int = 1 << 16) -> Iterator[tuple[int, int]]:
        """The records of a part of a file that is not compressed, by their lengths."""
        at, end = start, start + size
        while at < end:
            head = b""
            while b"\r\n\r\n" not in head and at + len(head) < end:
                head += self.read(at + len(head), min(step, end - at - len(head)))
            lines, found, _ = head.partition(b"\r\n\r\n")
            if not lines.startswith(b"WARC/") or not found:
                raise ValueError("no WARC record where one should begin")
            length = len(lines) + 4 + int(_fields(lines.decode())["content-length"]) + 4
            yield at, min(length, end - at)
            at += length


def _place(line: str) -> tuple[str, int, int] | None:
    """File, start and size that a line of an index names; None for a line of another form, such as a heading."""
    if "{" not in line:
        return None
    where = json.loads(line[line.index("{") :])
    if not {"filename", "offset", "length"} <= where.keys():
        return None
    return where["filename"].rpartition("/")[2], int(where["offset"]), int(where["length"])


def _fields(lines: str) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.split("\r\n")[1:])}


def record_at(data: bytes) -> dict:
    """`parsed` of a record as it is stored, packed or not."""
    return parsed(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)


def parsed(record: bytes) -> dict:
    """Headers and payload of a WARC record.

    The payload of an HTTP message is its body, that of any other block is the block; a revisit has none.  `page` and `refers_to` are
    the ids of records that this module wrote; `record_id` and `refers_to_id` are the ids as they stand.
    """
    head, _, rest = record.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head.decode())
    block = rest[: int(fields["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    is_http = block.startswith(b"HTTP/")
    payload = body if is_http else block
    said = _fields(http.decode("latin-1")) if is_http else {}
    kind = fields["warc-type"]
    name, other = (fields.get(n, "").strip("<>") or None for n in ("warc-record-id", "warc-refers-to"))
    if kind == "revisit":
        size = int(said["content-length"]) if said.get("content-length", "").isdigit() else None
        shown = (None, size, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None)
    else:
        shown = (payload, len(payload), digest(payload))
    return {
        "page": _page(name),
        "url": fields.get("warc-target-uri"),
        "payload": shown[0],
        "payload_bytes": shown[1],
        "payload_digest": shown[2],
        "record_type": kind,
        "refers_to": _page(other),
        "record_id": name,
        "refers_to_id": other,
    }


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix(PAGE_ID)
    return int(number) if (name or "").startswith(PAGE_ID) and number.lstrip("-").isdigit() else None


RECORD = (
    "page long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_id string"
)


def records_of(archives: DataFrame, path: str = "path") -> DataFrame:
    """The records of the archives in column `path`."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = list(Archive(name).ranges())
                columns = [[name] * len(found), [a for a, _ in found], [n for _, n in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["path", "start", "size"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, archive, rows, held = None, None, [], 0
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)
        for batch in batches:
            for path_, start, size in zip(*(c.to_pylist() for c in batch.columns)):
                if path_ != name:
                    name, archive = path_, Archive(path_)
                rows.append(record_at(archive.read(start, size)))
                held += len(rows[-1]["payload"] or b"")
                if held > RANGE_BYTES or len(rows) >= 5000:
                    yield pack()
                    rows, held = [], 0
        if rows:
            yield pack()

    # Rows are small and what they stand for is not: a number of partitions keeps them apart.
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = archives.select(F.col(path).alias("path")).repartition(parts, "path").mapInArrow(locate, "path string, start long, size long")
    spread = places.repartition(parts, "path", F.floor(F.col("start") / RANGE_BYTES)).sortWithinPartitions("path", "start")
    return spread.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0) -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to) as read back from archives written for the pages."""
    folder = shared_folder(pages.sparkSession, "archives")
    made_folder(folder)
    archives = write_archives(pages, folder, key, url, body, least_bytes)
    kind = column_type(pages, key)
    return records_of(archives).select(
        F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def made_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)
