"""WARC archives packaged as ZIP: written by tasks, read by ranges.

A package is a ZIP with stored members: `archive/data.warc.gz` (one gzip member per
record) and `indexes/index.cdxj` (sorted by URL key, with each record's place). Nothing
is extracted: the reader gets the directory from the end of the file (ZIP64 included),
the indexes by ranges, a piece at a time, and records by their own ranges. It also reads
packages that other writers made: several archives, several indexes, plain, gzipped or
deflated; side files of any kind are passed over.

Files are named by task attempt and listed in a table that Spark commits, so a lost
task leaves files that no one reads. Tasks reach any store that Arrow's file systems do.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import materialise

#: Payloads of fewer bytes are never written as revisits.
LEAST = 1000
#: Bytes of an index read at a time, and entries handed on.
_PIECE, _INDEXED = 1 << 20, 50_000
#: Compressed bytes of records in a package, about.
PACKAGE = 64 << 20

_DATA, _INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Characters that end a field or, for some readers, a line of the index.
_BREAKS = re.compile("[\\x00-\\x20\\x7f-\\x9f\\u2028\\u2029]")
_NO_ID = "urn:uuid:" + "f" * 8 + "-0000-0000-0000-" + "f" * 12

# ---------------------------------------------------------------- records


def _record_id(page: int | None) -> str:
    """A page's id as a UUID and back."""
    return _NO_ID if page is None else uuid.UUID(int=page & (1 << 64) - 1).urn


def _page(record_id: str) -> int | None:
    """Null for ids that other writers gave."""
    if record_id == _NO_ID or not record_id.startswith("urn:uuid:"):
        return None
    value = uuid.UUID(record_id).int
    if value >> 64:
        return None
    return value - (1 << 64) if value >> 63 else value


def record(page: int | None, url: str, payload: bytes, sha1: bytes, refers: int | None) -> bytes:
    """One WARC record: a response, or a revisit with the headers of the response alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if refers is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <{_record_id(page)}>",
        f"WARC-Target-URI: {url}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        lines[2:2] = [f"WARC-Refers-To: <{_record_id(refers)}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """What a record says of its page, from its own headers and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(":", 1) for line in head.decode().split("\r\n")[1:])
    fields = {name.lower(): value.removeprefix(" ") for name, value in fields.items()}
    block = rest[: int(fields["content-length"])]
    kind, length, payload = fields["warc-type"], None, block
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        for line in http.decode("latin-1").lower().split("\r\n"):
            if line.startswith("content-length:"):
                length = int(line.split(":")[1])
    said = fields.get("warc-payload-digest", "")
    known = said.startswith("sha1:") and len(said) == 37
    digest = base64.b32decode(said[5:].upper()) if known else None
    if kind != "revisit":
        real = hashlib.sha1(payload).digest()
        if digest not in (None, real) or length not in (None, len(payload)):
            raise ValueError(f"damaged record {fields['warc-record-id']}")
        digest, length = real, len(payload)
    refers = fields.get("warc-refers-to")
    return {
        "page_id": _page(fields["warc-record-id"][1:-1]),
        "url": fields.get("warc-target-uri"),
        "payload": None if kind == "revisit" else payload,
        "payload_bytes": length,
        "payload_digest": digest.hex() if digest else None,
        "record_type": kind,
        "refers_to": _page(refers[1:-1]) if refers else None,
    }


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then path and query; the URL itself
    if it can't be taken apart. Blanks, control characters and line separators are
    percent-encoded."""
    try:
        parts = urlsplit(url)
    except ValueError:
        key = url
    else:
        host = (parts.hostname or "").removeprefix("www.")
        query = f"?{parts.query}" if parts.query else ""
        key = f"{','.join(reversed(host.split('.')))}){(parts.path or '/')}{query}"
    return _BREAKS.sub(lambda c: quote(c[0]), key).lower()


# ---------------------------------------------------------------- packages


class _Package:
    """One ZIP being written, straight to its store."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        files, path = pafs.FileSystem.from_uri(self.path)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = files.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(zipfile.ZipInfo(_DATA), "w", force_zip64=True)
        self.size, self.index = 0, []

    def add(self, page, url: str, payload: bytes, sha1: bytes, refers) -> None:
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = packer.compress(record(page, url, payload, sha1, refers)) + packer.flush()
        self.member.write(data)
        place = {"url": url, "digest": f"sha1:{base64.b32encode(sha1).decode()}",
                 "offset": self.size, "length": len(data), "filename": "data.warc.gz"}
        self.index.append(f"{url_key(url)} {_DATE} {json.dumps(place)}")
        self.size += len(data)

    def close(self) -> tuple[str, int]:
        self.member.close()
        self.index.sort()
        with self.zip.open(zipfile.ZipInfo(_INDEX), "w", force_zip64=True) as member:
            for line in self.index:
                member.write(line.encode() + b"\n")
        self.zip.close()
        self.stream.close()
        return self.path, len(self.index)


def _write(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for page, url, html, sha1, refers in zip(
                *(c.to_pylist() for c in batch.columns), strict=True
            ):
                package = package or _Package(folder)
                package.add(page, url, html.encode(), bytes.fromhex(sha1), refers)
                if package.size >= size:
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        if done:
            paths, counts = zip(*done, strict=True)
            yield pa.record_batch({"path": pa.array(paths), "records": pa.array(counts, pa.int64())})

    return run


@dataclass(frozen=True)
class Member:
    """Where a member's bytes are, and how they are packed (0: stored, 8: deflated)."""

    start: int
    size: int
    method: int


def directory(stream: pa.NativeFile) -> dict[str, tuple[int, int]]:
    """Start and size of each stored member, from the central directory."""
    found = members(stream).items()
    return {name: (m.start, m.size) for name, m in found if m.method == 0}


def members(stream: pa.NativeFile) -> dict[str, Member]:
    """All members, from the central directory."""
    size = stream.size()
    tail_at = max(0, size - 65557)
    tail = stream.read_at(size - tail_at, tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        locator = stream.read_at(20, tail_at + end - 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<Q", locator, 8)
        length, start = struct.unpack_from("<QQ", stream.read_at(56, at), 40)
    data, at, out = stream.read_at(length, start), 0, {}
    while at < length:
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        (method,) = struct.unpack_from("<H", data, at + 10)
        packed, full = struct.unpack_from("<II", data, at + 20)
        name_size, extra_size, note_size = struct.unpack_from("<HHH", data, at + 28)
        (header,) = struct.unpack_from("<I", data, at + 42)
        name = data[at + 46 : at + 46 + name_size].decode()
        extra = data[at + 46 + name_size : at + 46 + name_size + extra_size]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:  # ZIP64: those of the fields that didn't fit, in this order
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                header = wide.pop(0) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        local = stream.read_at(30, header)
        start_at = header + 30 + sum(struct.unpack_from("<HH", local, 26))
        out[name] = Member(start_at, packed, method)
        at += 46 + name_size + extra_size + note_size
    return out


def _open(path: str) -> pa.NativeFile:
    files, place = pafs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def _chunks(stream: pa.NativeFile, name: str, member: Member) -> Iterator[bytes]:
    """A member's content in pieces: inflated if it is deflated, and if it is a gzip file."""
    if member.method not in (0, 8):
        raise ValueError(f"{name} is packed in a way that is not read")
    whole = (
        stream.read_at(min(_PIECE, member.size - at), member.start + at)
        for at in range(0, member.size, _PIECE)
    )
    if member.method == 8:
        whole = _inflated(whole, -15)
    return _inflated(whole, 31) if name.endswith(".gz") else whole


def _inflated(pieces: Iterator[bytes], window: int) -> Iterator[bytes]:
    """One stream after the other, as a gzip file may have many; a piece at a time."""
    unpack, begun = zlib.decompressobj(window), False
    for piece in pieces:
        while piece:
            begun = True
            yield unpack.decompress(piece, _PIECE)
            piece = unpack.unconsumed_tail
            if unpack.eof:
                piece, begun = unpack.unused_data, False
                unpack = zlib.decompressobj(window)
                if window < 0:
                    return
    if begun:
        yield unpack.flush()


def _lines(pieces: Iterator[bytes]) -> Iterator[str]:
    rest = b""
    for piece in pieces:
        *whole, rest = (rest + piece).split(b"\n")
        yield from (line.decode() for line in whole)
    if rest:
        yield rest.decode()


_INDEXES = (".cdxj", ".cdx", ".cdxj.gz", ".cdx.gz")


def _places(path: str) -> Iterator[tuple[str, int, int]]:
    """URL key, start and length of each record that a package's indexes list."""
    with _open(path) as stream:
        found = members(stream)
        data = {name: m for name, m in found.items() if name.startswith("archive/")}
        for name, member in found.items():
            if not (name.startswith("indexes/") and name.endswith(_INDEXES)):
                continue
            for line in _lines(_chunks(stream, name, member)):
                if not line.strip() or line.startswith(("!", " ")):
                    continue  # a remark on the index itself
                key, _, place = line.rstrip("\r").split(" ", 2)
                place = json.loads(place)
                file = place.get("filename")
                if file is None and len(data) == 1:
                    (file,) = data
                home = data.get(f"archive/{file}", data.get(file))
                if home is None:
                    raise ValueError(f"{path} has no archive {file}")
                if home.method != 0:
                    raise ValueError(f"{path}: {file} is not stored, so its records have no ranges")
                yield key, home.start + int(place["offset"]), int(place["length"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            places = _places(path)
            while some := list(islice(places, _INDEXED)):
                keys, starts, lengths = zip(*some, strict=True)
                yield pa.record_batch({
                    "path": pa.array([path] * len(keys), pa.string()),
                    "url_key": pa.array(keys, pa.string()),
                    "offset": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                })


_RECORD = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, stream = None, None
    for batch in batches:
        rows, size = [], 0
        for name, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name != path:
                if stream:
                    stream.close()
                path, stream = name, _open(name)
            rows.append(parse(zlib.decompress(stream.read_at(length, offset), 31)))
            size += rows[-1]["payload_bytes"]
            if size > 4 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
    if stream:
        stream.close()


# ---------------------------------------------------------------- operator


def write_archives(
    pages: DataFrame, folder: str, least: int = LEAST, package_bytes: int = PACKAGE
) -> DataFrame:
    """Write all pages (page_id, url, html) as packages below `folder`; path and records of
    each, as a stored table.

    Of pages with equal payloads of at least `least` bytes, that of the largest page_id is
    the response that the others revisit. Null html is empty, a null url too. Pages without
    id are responses; so is every row that repeats the largest id. Line breaks in a url
    become blanks. Other columns are not looked at. An empty table makes no package.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.translate(F.coalesce(F.col("url").cast("string"), F.lit("")), "\r\n", "  ").alias("url"),
        html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"),
    )
    repeated = (
        rows.filter((F.octet_length("html") >= least) & F.col("page_id").isNotNull())
        .groupBy("sha1").agg(F.max("page_id").alias("largest"), F.min("page_id").alias("smallest"))
        .filter("smallest < largest").select("sha1", "largest")
    )
    records = rows.join(repeated, "sha1", "left").select(
        "page_id", "url", "html", "sha1",
        F.when(F.col("page_id") < F.col("largest"), F.col("largest")).alias("refers_to"),
    )
    return materialise(
        records.mapInArrow(_write(folder, package_bytes), "path string, records bigint"),
        "packages",
    )


def read_index(packages: DataFrame) -> DataFrame:
    """path, url_key, offset, length of every record that the indexes of the packages (path)
    list. An archive that an index names must be stored in the package."""
    return packages.select("path").mapInArrow(
        _entries, "path string, url_key string, offset bigint, length bigint"
    )


def read_records(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """The records at the places of `index`: page_id, url, payload (null for revisits),
    payload_bytes, payload_digest (hex SHA-1), record_type, refers_to.

    Any selection of `index` reads just its ranges. Stretches of a package are dealt out,
    so a large package is read by several tasks."""
    n = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / F.lit(4 << 20))
    return (
        index.repartition(n, F.col("path"), stretch)
        .sortWithinPartitions("path", "offset")
        .select("path", "offset", "length")
        .mapInArrow(
            _read,
            "page_id bigint, url string, payload binary, payload_bytes bigint, "
            "payload_digest string, record_type string, refers_to bigint",
        )
    )


__all__ = ["directory", "parse", "read_index", "read_records", "record", "write_archives"]
