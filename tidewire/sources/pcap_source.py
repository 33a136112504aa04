"""Capture files as a data source: ``spark.read.format("capture")`` and ``spark.readStream.format("capture")``.

Large pcap files are split: a task starts anywhere and looks for the next place where a chain of packet headers begins, reads
the packets that begin in its range, and checks at its end that the next task, by the same search, starts where it stops. A mismatch is an
error, never a loss. pcapng files hold state that later blocks need, so each is one task, which reads it piece by piece. As a stream, a file's
whole packets so far are read up to a bound that the next batch begins at, so files may grow.

Files are reached through pyarrow's file systems (a URI) or as local paths that all workers see; ``capture.read`` takes any store of Spark's, a file a cell.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import capture

#: Bytes of a file that a task reads, that are read at once, and that the search for a chain looks over at most.
SPLIT, PIECE, SEARCH = 128 << 20, 4 << 20, 1 << 20
#: Headers in a row that make a chain, the longest packet, and the furthest that neighbours may be apart, in seconds.
CHAIN, LONGEST, APART = 16, 1 << 18, 7 * 86_400


def _files(path: str) -> list[tuple[str, int]]:
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    prefix = path.rstrip("/")
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((prefix + f.path[len(at.rstrip("/")) :], f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Packets:
    """One pcap file: its order of bytes and unit of time, and its packets from a place on."""

    def __init__(self, path: str):
        store, at = _store(path)
        self.file = store.open_input_file(at)
        self.size = self.file.size()
        head = self.file.read_at(min(24, self.size), 0)
        magic = struct.unpack("<I", head[:4])[0] if len(head) >= 4 else 0
        self.order, self.scale = capture.MAGICS.get(magic, (None, 0))
        self.plain = self.order is not None and len(head) == 24
        said = struct.unpack_from(self.order + "I", head, 16)[0] if self.plain else 0
        self.snap = said if 0 < said < LONGEST else LONGEST
        self.other = magic == capture.SECTION
        if len(head) >= 4 and not self.plain and not self.other:
            raise ValueError(f"no capture file: {path}")

    def __enter__(self) -> Packets:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def header(self, data: bytes, at: int) -> tuple[int, int, int, int]:
        return struct.unpack_from(self.order + "IIII", data, at)

    def _fits(self, head: tuple[int, int, int, int], before: int | None) -> bool:
        sec, part, size, whole = head
        return 0 < size <= self.snap and size <= whole <= LONGEST and part < 1_000_000_000 // self.scale and (before is None or abs(sec - before) <= APART)

    def chain(self, data: bytes, at: int, ends: bool) -> tuple[int, bool]:
        """How many headers in a row fit from a place of data on, up to ``CHAIN``, and whether they end as packets do: after enough of them, or just at the file's end (``ends``: data go there)."""
        before, n = None, 0
        while n < CHAIN:
            if at == len(data) and ends:
                return n, n > 0
            if at + 16 > len(data):
                return n, False
            head = self.header(data, at)
            if not self._fits(head, before):
                return 0, False
            before, at, n = head[0], at + 16 + head[2], n + 1
        return n, True

    def _closest(self, data: bytes, at: int, ends: bool) -> int:
        """Bytes that pass for a header may lead to a true packet by chance: of chains that meet at its end the one with more packets before it is the true one."""
        after = at + 16 + self.header(data, at)[2]
        for i in range(at + 1, min(after, len(data) - 16)):
            k = i
            while k < after and k + 16 <= len(data) and self._fits(self.header(data, k), None):
                k += 16 + self.header(data, k)[2]
            if k == after and self.chain(data, i, ends)[1]:
                return self._closest(data, i, ends)
        return at

    def bound(self, at: int) -> int:
        """The first place from ``at`` on at which a packet begins, by search; the file's size if none does. Where the last packet is cut off, the longest chain that leads to it."""
        if at <= 24:
            return min(24, self.size)
        look = min(SEARCH, self.size - at)
        data = self.file.read_at(min(look + CHAIN * (LONGEST + 16), self.size - at), at)
        ends = at + len(data) == self.size
        most, where = 0, self.size
        for i in range(look):
            n, whole = self.chain(data, i, ends)
            if whole:
                return at + self._closest(data, i, ends)
            if n > most:
                most, where = n, at + i
        if at + look < self.size:
            raise ValueError(f"no packet begins within {SEARCH} bytes of {at}; read the file with splitBytes=0")
        return where

    def read(self, start: int, end: int) -> Iterator[tuple[int, int, int, bytes]]:
        """(place, ts_ns, original length, bytes) of the packets that begin in [start, end), start being one of theirs; returns where the next one begins."""
        at, data, base = start, b"", start
        while at < end:
            if at + 16 > base + len(data) or at + 16 + self.header(data, at - base)[2] > base + len(data):
                data, base = self.file.read_at(min(max(PIECE, LONGEST + 16), self.size - at), at), at
            if len(data) < 16 or len(data) < 16 + self.header(data, 0)[2] and at == base:
                return self.size  # cut off
            sec, part, size, whole = self.header(data, at - base)
            if at + 16 + size > base + len(data):
                continue
            yield at, sec * 1_000_000_000 + part * self.scale, whole, data[at - base + 16 : at - base + 16 + size]
            at += 16 + size
        return at

    def last(self, least: int) -> int:
        """Where the last whole packet ends, not before ``least``, which is a bound."""
        at = least
        if self.size - least > SEARCH:
            at = self.bound(self.size - SEARCH)
        data = self.file.read_at(self.size - at, at)
        i = 0
        while i + 16 <= len(data) and i + 16 + self.header(data, i)[2] <= len(data):
            i += 16 + self.header(data, i)[2]
        return at + i


class Range(InputPartition):
    """A range of a file; ``exact``: its start is known to be a packet's."""

    def __init__(self, path: str, start: int, end: int, exact: bool, last: bool):
        super().__init__(None)
        self.path, self.start, self.end, self.exact, self.last = path, start, end, exact, last


def _rows(part: Range) -> Iterator[pa.RecordBatch]:
    with Packets(part.path) as p:
        if p.other:
            packets = ((i, *f) for i, f in enumerate(_blocks(p)))
        elif p.plain:
            packets = _checked(p, part)
        else:
            return
        rows = []
        for place, ts, whole, frame in packets:
            rows.append((part.path, place, ts, whole, frame))
            if len(rows) == capture.ROWS:
                yield capture._batch(rows)
                rows = []
        if rows:
            yield capture._batch(rows)


def _checked(p: Packets, part: Range) -> Iterator[tuple[int, int, int, bytes]]:
    start = part.start if part.exact else p.bound(part.start)
    end = min(part.end, p.size)
    if start >= end:
        return
    stop = yield from p.read(start, end)
    if not part.last and stop != p.bound(end):
        raise ValueError(f"packets of {part.path} end at {stop}, the next range begins at {p.bound(end)}; read the file with splitBytes=0")


def _blocks(p: Packets) -> Iterator[tuple[int, int, bytes]]:
    """Packets of a pcapng file, read block by block: what ``capture.frames`` tells of a section's start and one packet block after the other."""
    at, prefix, order = 0, b"", "<"
    while at + 12 <= p.size:
        head = p.file.read_at(min(12, p.size - at), at)
        kind = struct.unpack_from(order + "I", head)[0]
        if kind == capture.SECTION:
            order = "<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">"
            prefix = b""
        size = struct.unpack_from(order + "I", head, 4)[0]
        if size < 12 or at + size > p.size:
            return
        block = p.file.read_at(size, at)
        if kind in (capture.SECTION, capture.INTERFACE):
            prefix += block
        elif kind == capture.PACKET:
            yield from capture.frames(prefix + block)
        at += size


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        return [r for path, size in _files(self.path) for r in _ranges(path, 0, size, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


def _ranges(path: str, start: int, end: int, split: int) -> list[Range]:
    """Ranges of [start, end), of which start is a packet's place (or 0: the file's head) and end is one or the file's end."""
    first = max(start, 24)
    with Packets(path) as p:
        if p.other:
            return [Range(path, 0, end, True, True)] if start == 0 else []
    if not split or end - first <= split:
        return [Range(path, first, end, True, True)]
    edges = [*range(first, end, split), end]
    return [Range(path, a, b, a == first, b == end) for a, b in zip(edges, edges[1:], strict=False)]


class CaptureStream(DataSourceStreamReader):
    """Offsets are places in files: {path: bytes}. Files may be added and grow; pcapng files are taken when first seen, whole."""

    def __init__(self, options: dict):
        self.path, self.split, self.known = options["path"], int(options.get("splitBytes", SPLIT)), {}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({})}

    def latestOffset(self) -> dict:
        now = {}
        for path, size in _files(self.path):
            if size < 24:
                continue
            with Packets(path) as p:
                now[path] = p.last(max(self.known.get(path, 0), 24)) if p.plain else size
        self.known |= now
        return {"files": json.dumps(self.known)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        old, new = json.loads(start["files"]), json.loads(end["files"])
        self.known = dict(new)
        return [r for path, to in sorted(new.items()) if to > old.get(path, 0) for r in _ranges(path, old.get(path, 0), to, self.split)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _rows(partition)

    def commit(self, end: dict) -> None:
        pass


class CaptureSource(DataSource):
    """Options: ``path`` (a file, or a folder of them), ``splitBytes`` (0: a file a task). Its columns are those of ``capture.RAW``; ``capture.named`` makes packets of them."""

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return capture.RAW

    def reader(self, schema) -> CaptureReader:  # noqa: ANN001
        return CaptureReader(self.options)

    def streamReader(self, schema) -> CaptureStream:  # noqa: ANN001
        return CaptureStream(self.options)


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """Packets of the capture files under a path, with ts_us. ``seq`` is the packet's place in its file (pcapng: its number)."""
    spark.dataSource.register(CaptureSource)
    return capture.named(spark.read.format("capture").option("splitBytes", split_bytes).load(path))


def follow(spark: SparkSession, path: str, split_bytes: int = SPLIT) -> DataFrame:
    """The same as a stream over files that are added and grow."""
    spark.dataSource.register(CaptureSource)
    return capture.named(spark.readStream.format("capture").option("splitBytes", split_bytes).load(path))
