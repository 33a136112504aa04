"""Packets as rows of header bits: 1, 0, and -1 where there is no such bit. Frames are read by numpy over Arrow's buffers, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Headers in the order of the matrix, with the most bytes that each has.
HEADERS = {"ipv4": 60, "ipv6": 40, "tcp": 60, "udp": 8, "icmp": 8}


def _taken(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Bits of the bytes [start, start + size) of each row, up to a width in bytes; -1 beyond."""
    at = start[:, None] + np.arange(width)
    there = np.arange(width) < size[:, None]
    octets = data[np.where(there, at, 0)] if len(data) else np.zeros((len(start), width), np.uint8)
    bits = np.unpackbits(octets, axis=1).astype(np.int8)
    bits[~np.repeat(there, 8, axis=1)] = -1
    return bits


def matrix(frames: pa.Array, payload: int = 0) -> np.ndarray:
    """One row a frame (Ethernet, VLAN tags passed over): the bits of ``HEADERS`` and of so many bytes of payload. Later fragments have no transport header; what is cut off is -1."""
    frames = frames.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + len(frames) + 1]
    data = np.frombuffer(frames.buffers()[2], np.uint8) if frames.buffers()[2] else np.zeros(0, np.uint8)
    begin, end = raw[:-1], raw[1:]
    n = len(begin)

    def octet(at: np.ndarray) -> np.ndarray:
        fine = at < end
        return np.where(fine, data[np.where(fine, at, 0)], 0).astype(np.int64) if len(data) else np.zeros(n, np.int64)

    at = begin + 12
    for _ in range(2):  # tags
        kind = octet(at) << 8 | octet(at + 1)
        at = np.where(np.isin(kind, (0x8100, 0x88A8)), at + 4, at)
    kind, at = octet(at) << 8 | octet(at + 1), at + 2
    left = np.maximum(end - at, 0)
    four, six = (kind == 0x0800) & (left >= 20), (kind == 0x86DD) & (left >= 40)
    head = np.where(four, (octet(at) & 15) * 4, np.where(six, 40, 0))
    proto = np.where(four, octet(at + 9), np.where(six, octet(at + 6), -1))
    first = ~four | ((octet(at + 6) & 31) << 8 | octet(at + 7) == 0)
    above = at + head
    left_above = np.where((four | six) & first, np.maximum(end - above, 0), 0)
    tcp, udp, icmp = (proto == 6) & (left_above >= 20), (proto == 17) & (left_above >= 8), np.isin(proto, (1, 58)) & (left_above >= 8)
    size = np.where(tcp, (octet(above + 12) >> 4) * 4, np.where(udp | icmp, 8, 0))
    cut = lambda present, base, most: np.where(present, np.minimum(most, np.maximum(end - base, 0)), 0)
    spans = {"ipv4": (at, cut(four, at, head)), "ipv6": (at, cut(six, at, head)), "tcp": (above, cut(tcp, above, size)), "udp": (above, cut(udp, above, size)), "icmp": (above, cut(icmp, above, size))}
    parts = [_taken(data, *spans[h], width) for h, width in HEADERS.items()]
    if payload:
        body = above + size
        parts.append(_taken(data, body, cut(tcp | udp | icmp, body, np.full(n, payload)), payload))
    return np.concatenate(parts, axis=1)


def width(payload: int = 0) -> int:
    return 8 * (sum(HEADERS.values()) + payload)


def bits(frames: DataFrame, payload: int = 0, data: str = "data") -> DataFrame:
    """rows with ``bits``, an array of ``width`` numbers, instead of their frame."""
    kept = [f for f in frames.schema.fields if f.name != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                m = matrix(part.column(len(kept)), payload)
                flat = pa.array(m.reshape(-1), pa.int8())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], lists], [*(f.name for f in kept), "bits"])

    return frames.select(*(f.name for f in kept), data).mapInArrow(run, T.StructType([*kept, T.StructField("bits", T.ArrayType(T.ByteType()))]))


def flow_matrices(packets: DataFrame, key: list[str], payload: int = 0, most: int | None = None) -> DataFrame:
    """Packets (key, ts_us, seq, data) as rows of their flow's matrix: key, nth (from 0), bits. ``most``: only the first packets of each flow."""
    p = packets.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("ts_us", "seq")) - 1)
    if most is not None:
        p = p.filter(F.col("nth") < most)
    return bits(p.select(*key, "nth", "data"), payload)
