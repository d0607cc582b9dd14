"""WARC records in ZIP packages: a writer, and a reader that never extracts.

The writer packs the records of a task into ZIP files with two stored members, the WARC file and a line index with
each record's offset and length.  The reader parses the end record, its ZIP64 forms and the central directory, finds
the stored members through their local headers, and reads index and records as byte ranges of the package.  As usual
for WARC, each record is a gzip member of its own, so a range is read and unpacked without its neighbours.

Cases: a null html is an empty payload; an empty payload is a payload like others; a null page_id is kept as null and
is never the larger one; rows that repeat the largest page_id of a payload are all responses; a null url is written as
an empty one and read as null; an empty table writes no package and reads as no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rowbatch, shared

#: Member names, and the bytes of records after which a package ends.
RECORDS, INDEX, PACKAGE_BYTES = "archive/data.warc.gz", "indexes/index.cdxj", 64 << 20
#: Fixed values of the ZIP format: signatures of the local header, central entry, end record and its ZIP64 forms.
LOCAL, ENTRY, END, END64, LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
#: Bytes of adjoining records that are read at once.
RANGE_BYTES = 4 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
READ = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, intact boolean"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it, from any task; Hadoop's names of S3 are the plain one's."""
    for name in ("s3a://", "s3n://"):
        if uri.startswith(name):
            uri = "s3://" + uri[len(name) :]
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and ``refers_to``: null for responses, else the largest page_id with an equal payload.

    Payloads meet by hash, as one row a payload: the hash side is pre-aggregated before its shuffle, and a payload
    that a third of all rows share is a skewed join key with a single partner, which adaptive execution splits.
    """
    keyed = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("h", F.sha2(F.col("html").cast("binary"), 256))
    largest = keyed.groupBy("h").agg(F.max("page_id").alias("largest"))
    own = F.col("page_id").eqNullSafe(F.col("largest"))
    return keyed.join(shared.dealt(largest), "h").select("page_id", "url", "html", F.when(~own, F.col("largest")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> tuple[bytes, dict]:
    """A WARC record, packed, and its index entry."""
    sha = digest(payload)
    kind = "response" if refers_to is None else "revisit"
    block = HTTP + payload if refers_to is None else HTTP
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    raw = gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)
    return raw, {"record": kind, "digest": sha, "length": len(raw)}


class _Sink:
    """A stream that ZipFile can only append to."""

    def __init__(self, stream: pa.NativeFile) -> None:
        self.stream, self.size = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


def write(pages: DataFrame, where: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of ``mark_revisits``' rows below ``where``; one row (path, records, bytes) a package.

    A task that runs again writes packages of other names; the rows returned name those of the attempt that counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(where)
        rows = ((*key, html) for batch in rowbatch.small(batches, "html") for *key, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "html"))))
        row = next(rows, None)
        while row is not None:
            path = f"{base}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zip"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(path) as stream:
                sink, offset, entries = _Sink(stream), 0, []
                with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                    with package.open(RECORDS, "w", force_zip64=True) as member:
                        while row is not None and offset < package_bytes:
                            page_id, url, refers_to, html = row
                            raw, entry = record(page_id, url, html.encode("utf-8"), refers_to)
                            member.write(raw)
                            entries.append(json.dumps({"offset": offset, **entry}))
                            offset += len(raw)
                            row = next(rows, None)
                    with package.open(INDEX, "w", force_zip64=True) as member:
                        for entry in entries:
                            member.write(entry.encode() + b"\n")
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([len(entries)], pa.int64()), "bytes": pa.array([sink.size], pa.int64())})

    return pages.mapInArrow(run, MANIFEST)


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int


class Package:
    """Byte ranges of the stored members of one ZIP file; ``source`` has ``seek``, ``read`` and ``size``."""

    def __init__(self, source: pa.NativeFile, size: int) -> None:
        self.source, self.size = source, size
        self.members = {m.name: m for m in self._directory()}

    def bytes_at(self, at: int, count: int) -> bytes:
        if at < 0 or at + count > self.size:
            raise ValueError(f"range {at}+{count} is outside the package of {self.size} bytes")
        self.source.seek(at)
        got = self.source.read(count)
        if len(got) != count:
            raise ValueError(f"short read at {at}")
        return got

    def _end(self) -> tuple[int, int, int]:
        """Number of entries, size and offset of the central directory."""
        count = min(self.size, 22 + 0xFFFF)
        tail = self.bytes_at(self.size - count, count)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > count or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != count):
            at = tail.rfind(END, 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        number, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if number == 0xFFFF or length == 0xFFFFFFFF or offset == 0xFFFFFFFF:
            place = self.size - count + at - 20
            found = self.bytes_at(place, 20) if place >= 0 else b""
            if found[:4] == LOCATOR64:
                wide = self.bytes_at(struct.unpack_from("<Q", found, 8)[0], 56)
                if wide[:4] != END64:
                    raise ValueError("no ZIP64 end of central directory")
                number, length, offset = struct.unpack_from("<QQQ", wide, 32)
        return number, length, offset

    def _directory(self) -> Iterator[Member]:
        number, length, offset = self._end()
        raw, at = self.bytes_at(offset, length), 0
        for _ in range(number):
            if raw[at : at + 4] != ENTRY:
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, names, extras, comments = struct.unpack_from("<IIHHH", raw, at + 20)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + names].decode("utf-8" if flags & 0x800 else "cp437")
            more, end = at + 46 + names, at + 46 + names + extras
            while more + 4 <= end:
                tag, count = struct.unpack_from("<HH", raw, more)
                if tag == 1:  # 64-bit forms, in this order, of those fields that are full
                    wide = iter(struct.unpack_from(f"<{count // 8}Q", raw, more + 4))
                    size = next(wide) if size == 0xFFFFFFFF else size
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                more += 4 + count
            if method == 0 and packed != size:
                raise ValueError(f"{name}: a stored member of two sizes")
            yield Member(name, method, size, header)
            at = end + comments

    def start(self, name: str) -> tuple[int, int]:
        """Offset in the package and size of a stored member's bytes."""
        member = self.members[name]
        if member.method != 0:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.bytes_at(member.header, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name}: no local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return member.header + 30 + names + extras, member.size

    def lines(self, name: str, block: int = 1 << 20) -> Iterator[bytes]:
        """The lines of a stored member, read block by block."""
        at, left = self.start(name)
        rest = b""
        while left:
            some = self.bytes_at(at, min(block, left))
            at, left = at + len(some), left - len(some)
            *whole, rest = (rest + some).split(b"\n")
            yield from whole
        if rest:
            yield rest


def records_of(package: Package, index: Package, most: int = RANGE_BYTES) -> Iterator[bytes]:
    """The packed records that the index names, in its order; adjoining ones are read in ranges of at most ``most`` bytes, or one record."""
    base, size = package.start(RECORDS)
    start, filled, lengths = 0, 0, []

    def held() -> Iterator[bytes]:
        raw, at = package.bytes_at(base + start, filled), 0
        for n in lengths:
            yield raw[at : at + n]
            at += n

    for line in index.lines(INDEX):
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > size:
            raise ValueError("the index points outside the archive member")
        if lengths and (entry["offset"] != start + filled or filled + entry["length"] > most):
            yield from held()
            lengths = []
        if not lengths:
            start, filled = entry["offset"], 0
        lengths.append(entry["length"])
        filled += entry["length"]
    if lengths:
        yield from held()


def parse(raw: bytes) -> dict:
    """What one WARC record says."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *fields = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    said = dict(f.split(": ", 1) if ": " in f else (f.rstrip(":"), "") for f in fields)
    block = rest[: int(said["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"page_id": number(said["WARC-Record-ID"]), "url": said["WARC-Target-URI"] or None, "record_type": said["WARC-Type"], "refers_to": number(said["WARC-Refers-To"]) if "WARC-Refers-To" in said else None}
    claimed = said["WARC-Payload-Digest"].removeprefix("sha1:")
    if out["record_type"] == "revisit":
        return out | {"payload": None, "payload_bytes": int(said["X-Payload-Length"]), "payload_digest": claimed, "intact": not payload}
    real = digest(payload)
    return out | {"payload": payload, "payload_bytes": len(payload), "payload_digest": real, "intact": real == claimed}


def read(packages: DataFrame, where: str, batch_bytes: int = 1 << 20) -> DataFrame:
    """One row a record of the packages that ``packages.path`` names, in the file system of ``where``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(where)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_file(path) as source, store.open_input_file(path) as again:
                    package, index = Package(source, source.size()), Package(again, again.size())
                    rows, held = [], 0
                    for raw in records_of(package, index):
                        rows.append(parse(gzip.decompress(raw)))
                        held += 256 + len(rows[-1]["payload"] or b"")
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.mapInArrow(run, READ)


def archive(pages: DataFrame, package_bytes: int = PACKAGE_BYTES) -> tuple[DataFrame, str]:
    """Writes ``pages`` now; the packages' manifest, a saved table, and their folder."""
    where = pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(shared.fresh(pages.sparkSession, "warc")).toUri().toString()
    if where.startswith("/"):
        where = f"file://{where}"
    elif where.startswith("file:/") and not where.startswith("file://"):
        where = where.replace("file:/", "file:///", 1)
    return shared.saved(write(mark_revisits(pages), where, package_bytes), "warc-manifest"), where
