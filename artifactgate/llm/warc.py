"""WARC records in ZIP packages: writing them and reading them by range.

A package is a ZIP file of stored members: ``archive/data.warc.gz``, one gzip
member per record, and ``indexes/index.cdxj``, one line of JSON per record with
its offset and length in the former. The reader parses the end of the ZIP file,
its central directory and, where there are, the ZIP64 ones, finds the stored
members and reads single records by their byte ranges, without extraction.

Files are reached through the file system that the shared folder's URI names. A
task gives its packages names of their own and returns a manifest; only packages
that a finished task returned are read, so a lost or repeated task leaves no
record twice.

Defined results: a null html is an empty payload; a null page_id is written as a
record id of its own kind and comes after all others; of rows that repeat the smallest page_id of a
payload each is a response. Other columns are passed over.
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
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from artifactgate.llm.common import shared_dir, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of records after which a task starts its next package.
PACKAGE_BYTES = 64 << 20
#: Payloads of at least so many bytes are written once and revisited.
REVISIT_BYTES = 0
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: str | None) -> str:
    return "<urn:null:page>" if page is None else f"<urn:page:{quote(page, safe='')}>"


def _page(urn: str) -> str | None:
    return unquote(urn[len("<urn:page:") : -1]) if urn.startswith("<urn:page:") else None


def record(page: str | None, url: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has no payload of its own."""
    block = _HTTP + (b"" if refers_to is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, by lower-case name, and its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


class Package:
    """A ZIP package, read by byte ranges through ``file``, which has size(), seek() and read()."""

    def __init__(self, file):
        self.file = file
        self.members = dict(self._directory())

    def range(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError("the package ends too early")
        return out

    def _directory(self) -> Iterator[tuple[str, tuple[int, int, int]]]:
        """Name -> (offset of the local header, bytes, method)."""
        size = self.file.size()
        tail = self.range(max(0, size - 65_557), min(size, 65_557))
        end = tail.rfind(b"PK\x05\x06")
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        locator = end - 20
        if locator >= 0 and tail[locator : locator + 4] == b"PK\x06\x07":
            big = self.range(struct.unpack_from("<Q", tail, locator + 8)[0], 56)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of the central directory")
            count, length, at = struct.unpack_from("<QQQ", big, 32)
        entries = self.range(at, length)
        p = 0
        for _ in range(count):
            if entries[p : p + 4] != b"PK\x01\x02":
                raise ValueError("a broken central directory")
            method, packed, plain, n, m, c = struct.unpack_from("<H8xIIHHH", entries, p + 10)
            (header,) = struct.unpack_from("<I", entries, p + 42)
            name = entries[p + 46 : p + 46 + n].decode("utf-8", "replace")
            extra = entries[p + 46 + n : p + 46 + n + m]
            while len(extra) >= 4:
                kind, own = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{own // 8}Q", extra, 4))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    header = next(wide) if header == 0xFFFFFFFF else header
                extra = extra[4 + own :]
            yield name, (header, packed, method)
            p += 46 + n + m + c

    def stored_at(self, name: str) -> tuple[int, int]:
        """Offset and bytes of a stored member."""
        header, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        local = self.range(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n, m = struct.unpack_from("<HH", local, 26)
        return header + 30 + n + m, size


class _Writer:
    """Writes records into a package; the index follows when it is closed."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        self.path = path
        self.stream = fs.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, page: str | None, raw: bytes) -> None:
        own = gzip.compress(raw, 4, mtime=0)
        self.data.write(own)
        self.index.append(json.dumps({"page": page, "offset": self.at, "length": len(own)}))
        self.at += len(own)

    def close(self) -> int:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return len(self.index)


def _file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html, digest, refers_to) rows to packages; the manifest (path, records), stored."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _file_system(folder)
        fs.create_dir(base, recursive=True)
        writer, done = None, []
        for batch in batches:
            for page, url, html, digest, refers in zip(*(c.to_pylist() for c in batch.columns)):
                writer = writer or _Writer(fs, f"{base}/{uuid.uuid4().hex}.wacz")
                page = None if page is None else str(page)
                clean = " ".join((url or "").split())
                writer.add(page, record(page, clean, (html or "").encode(), digest, None if refers is None else str(refers)))
                if writer.at >= PACKAGE_BYTES:
                    done.append((writer.path, writer.close()))
                    writer = None
        if writer:
            done.append((writer.path, writer.close()))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return stored(pages.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(write, "path string, records bigint"), "manifest")


def read_packages(manifest: DataFrame, folder: str) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to, payload) of every record that the packages' indexes name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _file_system(folder)
        names = ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    package = Package(file)
                    at, _ = package.stored_at(DATA)
                    entries = package.range(*package.stored_at(INDEX)).decode().splitlines()
                    for lo in range(0, len(entries), 128):
                        rows = []
                        for entry in map(json.loads, entries[lo : lo + 128]):
                            headers, payload = parse(zlib.decompress(package.range(at + entry["offset"], entry["length"]), 31))
                            kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                            if kind == "response" and digest != digest_of(payload):
                                raise ValueError(f"the payload of {headers['warc-record-id']} is not what its digest says")
                            refers = headers.get("warc-refers-to")
                            rows.append((_page(headers["warc-record-id"]), int(headers["x-payload-length"]), digest, kind, refers and _page(refers), payload))
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    n = max(1, min(10_000, manifest.count()))
    return manifest.select("path").repartition(n).mapInArrow(read, "page string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary")


def with_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of each payload's records all but that of the smallest page_id refer to it.

    Digests are computed in one narrow pass; only they are grouped, and texts are
    shuffled once, by page_id, which has no hot keys.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads = [(h or "").encode() for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([digest_of(p) for p in payloads]), pa.array([len(p) for p in payloads], pa.int64())], ["page_id", "digest", "size"])

    page = pages.schema["page_id"]
    digests = stored(pages.select("page_id", "html").mapInArrow(hashed, T.StructType([page, *T.StructType.fromDDL("digest string, size bigint").fields])), "digests")
    # Stored, so that a payload that a great part of the pages share is split by adaptive execution in both joins.
    first = stored(digests.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"), "first")
    refers = stored(digests.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("of"), F.col("digest").alias("same"), "first").distinct(), "refers")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.array([digest_of((h or "").encode()) for h in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, own], ["page_id", "url", "html", "digest"])

    rows = pages.select("page_id", "url", "html").mapInArrow(named, T.StructType([page, *T.StructType.fromDDL("url string, html string, digest string").fields]))
    joined = rows.join(refers, rows["page_id"].eqNullSafe(refers["of"]) & (rows["digest"] == refers["same"]), "left")
    return joined.select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, a row per record read back."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    folder = f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    manifest = write_packages(with_revisits(pages), folder)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.col(c).cast(kind)
    return read_packages(manifest, folder).select(page("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


#: DuckDB SQL for round_trip() over the table pages: base32 is read off the hexadecimal digest, four letters for five digits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, x, strlen(h) AS n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INT), 1)), '') AS payload_digest FROM p),
f AS (SELECT x, min(page_id) AS first FROM d GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d JOIN f USING (x)
"""
