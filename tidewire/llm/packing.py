"""Harmonic packing of token sequences.

A document's ids are cut at reciprocal capacities (1, 1/2 and 1/4 of the capacity) as long
as such a piece fits; what is left, shorter than a quarter, is one last piece. A piece of
length n is of class capacity // n, and a bin of class j takes exactly j pieces of it, so
that where a piece goes depends on nothing but how many of its class came before. Each
worker fills its own bins over its own partition: no shuffle, no state beyond one open bin
a class. At its end a worker puts the pieces of its open bins together by first fit,
longest first; there are at most capacity such pieces a class and worker, whatever the size
of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .tokens import Encoder, blocks

CAPACITY = 1024
#: Pieces of these lengths are cut off first; each is a reciprocal of the capacity.
CUTS = (1, 2, 4)

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, capacity_class int"


def pieces(length: int, capacity: int = CAPACITY, cuts: tuple[int, ...] = CUTS) -> list[tuple[int, int]]:
    """(start, length) of the pieces that a document of so many ids is cut into, gapless and in order."""
    out, at = [], 0
    for part in cuts:
        size = capacity // part
        while size and length - at >= size:
            out.append((at, size))
            at += size
    if at < length:
        out.append((at, length - at))
    return out


class Bins:
    """The open bins of one worker. add() yields placed pieces as (piece, sequence, offset); close() the rest."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next, self.open = capacity, first, {}

    def _seal(self, held: list) -> Iterator[tuple]:
        at = 0
        for piece, n in held:
            yield piece, self.next, at
            at += n
        self.next += 1

    def add(self, piece, n: int) -> Iterator[tuple]:
        j = self.capacity // n
        held = self.open.setdefault(j, [])
        held.append((piece, n))
        if len(held) == j:
            yield from self._seal(self.open.pop(j))

    def close(self) -> Iterator[tuple]:
        rest = sorted((x for held in self.open.values() for x in held), key=lambda x: -x[1])
        room: list[list] = []  # [free, pieces]
        for x in rest:
            spot = next((r for r in room if r[0] >= x[1]), None)
            if spot is None:
                room.append(spot := [self.capacity, []])
            spot[0] -= x[1]
            spot[1].append(x)
        self.open = {}
        for _, held in room:
            yield from self._seal(held)


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document, and in which sequence at which offset.

    A null text is an empty one and still yields its end id; a null key stays null; repeated
    rows are packed as often as they occur; no row gives no sequence. A very long text is cut over as many
    sequences as it needs. with_ids adds
    ``ids``, the piece's ids as little-endian unsigned 32-bit integers.
    """
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(tokenizer_path)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        out: list[tuple] = []

        def flush():
            rows, out[:] = list(zip(*out, strict=True)), []
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "capacity_class"] + ["ids"] * with_ids
            types = [pa.int64()] * 7 + [pa.int32()] + [pa.binary()] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)

        def put(placed):
            for (doc, start, n, crc, total, ids), sequence, offset in placed:
                out.append((doc, start, n, crc, total, sequence, offset, capacity // n) + ((ids,) if with_ids else ()))

        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for block in blocks(batch, 1):
                for doc, found in zip(block.column(0).to_pylist(), encoder.encode_all(block.column(1)), strict=True):
                    ids = np.concatenate((found, end)).tobytes()
                    total = len(ids) // 4
                    for start, n in pieces(total, capacity):
                        part = ids[4 * start : 4 * (start + n)]
                        put(bins.add((doc, start, n, zlib.crc32(part), total, part if with_ids else None), n))
                    if len(out) >= 8192:
                        yield flush()
        put(bins.close())
        if out:
            yield flush()

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
