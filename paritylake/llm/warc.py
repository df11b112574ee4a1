"""WARC records in ZIP archives: written by tasks, read by ranges without extraction.

An archive is a ZIP file whose members are stored, not compressed: WARC files of one gzip
member for each record below archive/, and an index line for each record below indexes/.
Reading parses the end record (ZIP64 too), the central directory and the local headers,
takes the index members, and then reads each record by its byte range.

Every task streams to a file of its own attempt; only files named in the committed
manifest count, so a task that is run again leaves no doubt. A file is closed after
`archive_bytes`, and one member is held in memory at a time.

Null payloads are empty, null URLs have no target header, null ids are kept as null.
Payloads of at least `least` bytes are shared: the row with the largest id is the
response (repeated rows of that id all are), others revisit it. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

# Layout constants of the ZIP format.
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
_FULL32, _FULL16 = 0xFFFFFFFF, 0xFFFF
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- ZIP ------------------------------------------------------------------------------

class ZipWriter:
    """Stored members to a stream that cannot seek. `zip64` forces the large layout."""

    def __init__(self, out: BinaryIO, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def add(self, name: str, data: bytes) -> None:
        raw, crc, size = name.encode(), zlib.crc32(data), len(data)
        large = self.zip64 or size >= _FULL32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if large else b""
        short = _FULL32 if large else size
        head = struct.pack("<IHHHHHIIIHH", _LOCAL, 45 if large else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra))
        self.members.append((raw, crc, size, self.at))
        for piece in (head, raw, extra, data):
            self.out.write(piece)
            self.at += len(piece)

    def close(self) -> int:
        start = self.at
        for raw, crc, size, at in self.members:
            big_size, big_at = self.zip64 or size >= _FULL32, self.zip64 or at >= _FULL32
            body = (struct.pack("<QQ", size, size) if big_size else b"") + (struct.pack("<Q", at) if big_at else b"")
            extra = struct.pack("<HH", 1, len(body)) + body if body else b""
            short = _FULL32 if big_size else size
            head = struct.pack("<IHHHHHHIIIHHHHHII", _CENTRAL, 45, 45 if body else 20, 0x800, 0, 0, 0x21, crc, short, short,
                               len(raw), len(extra), 0, 0, 0, 0, _FULL32 if big_at else at)
            self.out.write(head + raw + extra)
            self.at += len(head) + len(raw) + len(extra)
        n, size = len(self.members), self.at - start
        if self.zip64 or n >= _FULL16 or start >= _FULL32 or size >= _FULL32:
            tail = struct.pack("<IQHHIIQQQQ", _END64, 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<IIQI", _LOCATOR64, 0, self.at, 1)
            tail += struct.pack("<IHHHHIIH", _END, 0, 0, _FULL16, _FULL16, _FULL32, _FULL32, 0)
        else:
            tail = struct.pack("<IHHHHIIH", _END, 0, 0, n, n, size, start, 0)
        self.out.write(tail)
        self.at += len(tail)
        return self.at


def read_range(f, at: int, size: int) -> bytes:
    f.seek(at)
    data = f.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends within the range {at}+{size}")
    return bytes(data)


def directory(f, size: int) -> dict[str, tuple[int, int, int]]:
    """Members by name: method, offset of the data, stored size."""
    tail_at = max(0, size - 65_557)  # the end record and its longest comment
    tail = read_range(f, tail_at, size - tail_at)
    at = tail.rfind(struct.pack("<I", _END))
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", _END), 0, at + 3)  # the sign stood in the comment
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP archive")
    _, _, _, _, n, length, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    if _FULL16 == n or _FULL32 in (length, start):
        sign, _, end64, _ = struct.unpack("<IIQI", read_range(f, tail_at + at - 20, 20))
        if sign == _LOCATOR64:
            sign, _, _, _, _, _, _, n, length, start = struct.unpack("<IQHHIIQQQQ", read_range(f, end64, 56))
            if sign != _END64:
                raise ValueError("the ZIP64 locator points to no ZIP64 end record")
    raw, at, out = read_range(f, start, length), 0, {}
    for _ in range(n):
        (sign, _, _, _, method, _, _, _, stored, plain, names, extras, notes, _, _, _, local) = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if sign != _CENTRAL:
            raise ValueError("broken central directory")
        name, extra = raw[at + 46 : at + 46 + names].decode(), raw[at + 46 + names : at + 46 + names + extras]
        at += 46 + names + extras + notes
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<HH", extra)
            if tag == 1:  # 64-bit values of those fields that are full, in this order
                values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                plain = next(values) if plain == _FULL32 else plain
                stored = next(values) if stored == _FULL32 else stored
                local = next(values) if local == _FULL32 else local
            extra = extra[4 + width :]
        sign, *_, skip_name, skip_extra = struct.unpack("<IHHHHHIIIHH", read_range(f, local, 30))
        if sign != _LOCAL:
            raise ValueError(f"no local header for {name}")
        out[name] = (method, local + 30 + skip_name + skip_extra, stored)
    return out


# -- WARC records ---------------------------------------------------------------------

def _clean(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in value)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record; `digest` is the hex SHA-1 of the whole payload, which a revisit leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {_clean(url)}"] if url is not None else []
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if revisit else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of the HTTP response (lower-case names), and the payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _id(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


# -- tables ---------------------------------------------------------------------------

def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit.

    Only digests that occur twice are listed. Spark sees the size of that list: it is
    broadcast when small, else joined by shuffle, where adaptive execution splits a
    digest with very many rows.
    """
    body = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    owners = (
        rows.where(F.octet_length("payload") >= least).groupBy("digest")
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1 and owner is not null").drop("n")
    )
    joined = rows.join(written(owners, "warc-owners"), "digest", "left")
    revisit = F.coalesce(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner")), F.lit(False))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("owner")).alias("refers_to"), revisit.alias("revisit"))


def write(records: DataFrame, folder: str, archive_bytes: int = 256 << 20, member_bytes: int = 8 << 20, zip64: bool = False) -> DataFrame:
    """Write the planned records; the manifest (path, size, n_records) of the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = archive = None
        files, parts, lines, held, n = 0, [], [], 0, 0

        def member() -> None:
            nonlocal parts, lines, held
            k = len(archive.members) // 2
            archive.add(f"archive/data-{k:05d}.warc.gz", b"".join(parts))
            archive.add(f"indexes/data-{k:05d}.cdxj", b"".join(lines))
            parts, lines, held = [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal out, archive, n, files
            if parts:
                member()
            size = archive.close()
            out.close()
            row = pa.RecordBatch.from_pydict({"path": [name], "size": [size], "n_records": [n]})
            out = archive = None
            n, files = 0, files + 1
            return row

        name = ""
        for b in batches:
            columns = (b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))
            for page_id, url, payload, digest, refers_to, revisit in zip(*columns):
                if archive is None:
                    name = f"{base}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{files:03d}-{os.urandom(4).hex()}.wacz"
                    out = store.open_output_stream(name)
                    archive = ZipWriter(out, zip64)
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py(), revisit.as_py())
                squeezed = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = squeezed.compress(raw) + squeezed.flush()
                entry = {"id": page_id.as_py(), "offset": held, "length": len(data)}
                lines.append(f"{_clean(url.as_py() or '-')} {json.dumps(entry)}\n".encode("utf-8", "surrogatepass"))
                parts.append(data)
                held += len(data)
                n += 1
                if held >= member_bytes:
                    member()
                    if archive.at >= archive_bytes:
                        yield done()
        if archive is not None:
            yield done()

    return written(records.mapInArrow(run, "path string, size bigint, n_records bigint"), "warc-manifest")


def members(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each WARC member: path, data_at, offsets and lengths of its records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
                rows = {"path": [], "data_at": [], "offsets": [], "lengths": []}
                with store.open_input_file(path) as f:
                    found = directory(f, size)
                    for name, (method, at, stored) in found.items():
                        if name.startswith("indexes/") and method == 0:
                            lines = read_range(f, at, stored).split(b"\n")  # no other character ends a line
                            entries = [json.loads(x.decode("utf-8", "surrogatepass").partition(" ")[2]) for x in lines if x]
                            warc = found[name.replace("indexes/", "archive/").removesuffix(".cdxj") + ".warc.gz"]
                            if warc[0] != 0:
                                raise ValueError(f"{name}: its archive member is not stored")
                            rows["path"].append(path)
                            rows["data_at"].append(warc[1])
                            rows["offsets"].append([e["offset"] for e in entries])
                            rows["lengths"].append([e["length"] for e in entries])
                schema = pa.schema([("path", pa.string()), ("data_at", pa.int64()), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return manifest.mapInArrow(run, "path string, data_at bigint, offsets array<bigint>, lengths array<bigint>")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Range-read every record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = members(manifest, folder).repartition(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for b in batches:
            for path, data_at, offsets, lengths in zip(*(b.column(c).to_pylist() for c in ("path", "data_at", "offsets", "lengths"))):
                rows = []
                with store.open_input_file(path) as f:
                    for at, size in zip(offsets, lengths):
                        fields, http, payload = parse(zlib.decompress(read_range(f, data_at + at, size), 31))
                        said = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = fields["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != said:
                            raise ValueError(f"{fields['warc-record-id']}: payload and digest differ")
                        rows.append((_id(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-type"],
                                     _id(fields["warc-refers-to"]) if revisit else None, int(http["content-length"]), said, None if revisit else payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return listed.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary")


def archived(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write all pages to archives in the shared folder and read the records back."""
    folder = shared_path(pages.sparkSession, "warc")
    return read(write(plan(pages, least), folder), folder)
