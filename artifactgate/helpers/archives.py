"""Members of archives at any depth, read as streams.

ZIP files and tars, plain or compressed, are known by their first bytes or their
directory. A member is read in windows of bounded size with some bytes of its
neighbours, so that none stands whole in memory, an archive inside an archive
included. Each artifact's unpacked bytes are summed as they come: a bomb ends
with an error row, whatever its directory says. Links, and members whose names
leave the archive, are passed over; nothing is written to disk.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artifactgate import rules
from artifactgate.helpers.bytes import pickle_imports

#: Depth of archives in archives, bytes of a member at most, bytes unpacked in all, bytes up to which no ratio counts, and the most that packed bytes may unpack to.
MOST_DEPTH, MOST_MEMBER, MOST_PLAIN, FREE_PLAIN, MOST_RATIO = 3, 2 << 30, 4 << 30, 100 << 20, 200
WINDOW, OVERLAP = 4 << 20, 4096
#: Bytes of a member that a reader takes whole.
MOST_SMALL = 64 << 20


class Bomb(Exception):
    pass


class Sums:
    """Unpacked bytes of an artifact so far."""

    def __init__(self, packed: int):
        self.packed, self.plain = max(1, packed), 0

    def add(self, n: int) -> None:
        self.plain += n
        check(self.plain, self.packed)


def check(plain: int, packed: int) -> None:
    if plain > MOST_PLAIN or (plain > FREE_PLAIN and plain > MOST_RATIO * max(packed, 1)):
        raise Bomb


class Member(NamedTuple):
    """A member's path behind its archive's, its depth, and its bytes; or the error at which its archive breaks off."""

    path: str
    depth: int
    stream: BinaryIO | None
    error: str | None = None


def _unsafe(name: str) -> bool:
    plain = name.replace("\\", "/")
    return plain.startswith("/") or ".." in plain.split("/") or plain[1:2] == ":"


def _inside(stream: BinaryIO) -> Iterator[tuple[str, BinaryIO]]:
    """The safe, regular members of a ZIP or tar stream; none of any other.

    What begins as a tar is one, although a ZIP directory among its last members
    may make it look like the end of a ZIP file.
    """
    stream.seek(0)
    head = stream.read(512)
    packed = head[:2] == b"\x1f\x8b" or head[:3] == b"BZh" or head[:6] == b"\xfd7zXZ\0"
    if head[257:262] != b"ustar" and not packed:
        stream.seek(0)
        if zipfile.is_zipfile(stream):
            stream.seek(0)
            with zipfile.ZipFile(stream) as z:
                check(*(sum(getattr(i, size) for i in z.infolist()) for size in ("file_size", "compress_size")))
                for info in z.infolist():
                    if not info.is_dir() and not _unsafe(info.filename) and info.file_size <= MOST_MEMBER:
                        with z.open(info) as member:
                            yield info.filename, member
            return
        if head[:4] == b"PK\3\4":
            raise zipfile.BadZipFile
    stream.seek(0)
    try:
        tar = tarfile.open(fileobj=stream)
    except (tarfile.TarError, EOFError, OSError):
        if head[257:262] == b"ustar":
            raise
        return  # a compressed file that is no tar, or no archive at all
    with tar:
        for info in tar:
            if info.isfile() and not _unsafe(info.name) and info.size <= MOST_MEMBER:
                yield info.name, tar.extractfile(info)


def members(path: str, stream: BinaryIO, depth: int = 1, most: int = MOST_DEPTH) -> Iterator[Member]:
    """Every member, depth first; an archive among them before its own. A bomb is raised, any other fault is a Member with its error."""
    try:
        for name, inner in _inside(stream):
            own = f"{path}!{name}"
            yield Member(own, depth, inner)
            if depth < most:
                yield from members(own, inner, depth + 1, most)
    except Bomb:
        raise
    except Exception as e:  # noqa: BLE001  a broken archive
        yield Member(f"{path}!", depth, None, type(e).__name__)


def windows(stream: BinaryIO, window: int = WINDOW, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int, bytes]]:
    """(at, before, own, bytes): ``own`` bytes from offset ``at``, behind ``before`` and in front of more, where there are any."""
    at, before, held = 0, b"", stream.read(window + overlap)
    while held:
        own = min(window, len(held))
        yield at, len(before), own, before + held
        before, held = (before + held[:own])[-overlap:], held[own:] + stream.read(window)
        at += own


def could_hold(path: Column, content: Column) -> Column:
    """A cheap test that every archive passes: its first bytes, the end of a ZIP directory, or its name."""
    starts = lambda digits, at=1: F.substring(content, at, len(digits) // 2) == F.unhex(F.lit(digits))
    heads = starts("504B0304") | starts("504B0506") | starts("7573746172", 258) | starts("1F8B") | starts("425A68") | starts("FD377A585A00")
    tail = F.contains(F.substring(content, -65557, 65557), F.unhex(F.lit("504B0506")))
    return heads | tail | F.lower(path).rlike(r"\.(?:zip|tar|tgz)$")


def _read(artifacts: DataFrame, schema: str, kinds: list[pa.DataType], names: list[str], read, most: int, rows_at_once: int = 4096, bytes_at_once: int = 32 << 20) -> DataFrame:
    """Rows (target_id, path, depth, ...) of what ``read`` makes of each member; its rows go out in batches of bounded bytes."""
    every = ["target_id", "path", "depth", *names]
    every_kind = [pa.string(), pa.string(), pa.int32(), *kinds]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(every_kind)], every)

    def found(target: str, path: str, content: bytes) -> Iterator[tuple]:
        sums = Sums(len(content))
        try:
            for m in members(path, io.BytesIO(content), most=most):
                for row in read(m, sums):
                    yield target, m.path, m.depth, *row
        except Bomb:
            for row in read(Member(path, 0, None, "ArchiveBomb"), sums):
                yield target, path, 0, *row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for target, path, content in zip(*batch.columns):
                for row in found(target.as_py(), path.as_py() or "", content.as_py() or b""):
                    held.append(row)
                    size += sum(len(x) for x in row if isinstance(x, bytes))
                    if size > bytes_at_once or len(held) >= rows_at_once:
                        yield batch_of(held)
                        held, size = [], 0
            if held:
                yield batch_of(held)

    packed = artifacts.where(could_hold(F.col("path"), F.col("content")))
    return packed.select("target_id", "path", "content").mapInArrow(run, f"target_id string, path string, depth int, {schema}")


def member_windows(artifacts: DataFrame, window: int = WINDOW, overlap: int = OVERLAP, depth: int = MOST_DEPTH) -> DataFrame:
    """(target_id, path, depth, at, before, own, content, error) of every member of (target_id, path, content) artifacts, as windows for ``scan.matches``; a fault is a row without content."""

    def read(m: Member, sums: Sums) -> Iterator[tuple]:
        if m.stream is None:
            yield 0, 0, 0, None, m.error
            return
        for at, before, own, content in windows(m.stream, window, overlap):
            sums.add(own)
            yield at, before, own, content, None

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return _read(artifacts, "at bigint, before int, own int, content binary, error string", kinds, ["at", "before", "own", "content", "error"], read, depth)


class Counted(io.RawIOBase):
    """A member's stream that adds what is read to the artifact's sum."""

    def __init__(self, stream: BinaryIO, sums: Sums):
        self.stream, self.sums = stream, sums

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.stream.read(len(buffer))
        self.sums.add(len(data))
        buffer[: len(data)] = data
        return len(data)


def member_imports(artifacts: DataFrame, depth: int = MOST_DEPTH) -> DataFrame:
    """(target_id, path, depth, module, name, pos, calls, gadget_calls, error) of the pickles among the members, read as streams; what is no pickle gives no row."""

    def read(m: Member, sums: Sums) -> Iterator[tuple]:
        if m.stream is None:
            yield None, None, 0, 0, 0, m.error
            return
        head = m.stream.read(2)
        m.stream.seek(0)
        if m.path.lower().endswith(tuple(rules.STRICT_PICKLE)) or (head[:1] in HEADS and (head[:1] != b"\x80" or head[1:2] in b"\2\3\4\5")):
            for module, name, pos, calls, gadgets, error in pickle_imports(io.BufferedReader(Counted(m.stream, sums), 1 << 20)):
                if error is None:
                    yield module, name, pos, calls, gadgets, None

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    return _read(artifacts, "module string, name string, pos bigint, calls int, gadget_calls int, error string", kinds, ["module", "name", "pos", "calls", "gadget_calls", "error"], read, depth)


#: First bytes of pickles.
HEADS = (b"\x80", b"(", b"]", b"}", b"c", b"\x8c", b")")


def small_members(artifacts: DataFrame, name: str, depth: int = MOST_DEPTH, most: int = MOST_SMALL) -> DataFrame:
    """(target_id, path, depth, content, error) of the members of that name, whole; a larger one has the error TooLarge."""

    def read(m: Member, sums: Sums) -> Iterator[tuple]:
        if m.stream is None:
            yield None, m.error
        elif m.path.rpartition("!")[2] == name:
            content = m.stream.read(most + 1)
            sums.add(len(content))
            yield (content, None) if len(content) <= most else (None, "TooLarge")

    return _read(artifacts, "content binary, error string", [pa.binary(), pa.string()], ["content", "error"], read, depth)
