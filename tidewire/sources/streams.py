"""Messages out of ordered TCP streams: connections by their opening numbers, bytes put in order, and readers that cut messages out of them.

A stream is what one side of one connection sends. Its segments are dealt by key and connection and sorted within partitions, which
spills; a reader then sees one segment at a time and keeps only the bytes of a message that is not whole yet. Copies and overlaps go to the
first copy; after a gap a stream is not read on, as nothing tells where its next message begins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What one side of a 5-tuple sends.
SIDE = ["src_ip4", "src_port", "dst_ip4", "dst_port"]
_SYN, _SPACE = 2, 1 << 32
#: A message of more bytes ends the reading of its stream.
MOST = 1 << 20
#: The start of a stream, in which hellos and offers are looked for: some records of the largest size.
HEAD = 1 << 17


def side_of(packets: DataFrame) -> list[str]:
    """The columns of a side, with IPv6 addresses where there are such."""
    return [*SIDE, *(c for c in ("src_ip6", "dst_ip6") if c in packets.columns)]


def _step(a: Column, b: Column) -> Column:
    """a - b on the ring of sequence numbers, from -2^31 to 2^31 - 1."""
    half = _SPACE >> 1
    return F.pmod(a - b + half, F.lit(_SPACE)) - half


def placed(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """TCP segments with payload: by, conn, offset, ts_us, seq, payload. ``offset`` counts a stream's bytes from 0.

    A SYN of another ``tcp_seq`` than its side's last begins connection 1, 2, ...; what comes before any SYN, or where there are no ``tcp_flags``,
    is connection 0. Numbers may wrap round, any number of times: places are sums of steps from segment to segment in order of time. The first place
    is the SYN's, or the lowest. All of this goes by in one running pass over a side's segments, which holds no more than a row.
    """
    by = side_of(packets) if by is None else by
    w = Window.partitionBy(*by).orderBy("ts_us", "seq")
    number = F.col("tcp_seq").cast("long")
    p = packets.filter("proto = 6").select(*by, "tcp_seq", "ts_us", "seq", "payload", *(["tcp_flags"] if "tcp_flags" in packets.columns else []))
    p = p.withColumn("pos_", F.sum(F.coalesce(_step(number, F.lag(number).over(w)), F.lit(0))).over(w))
    if "tcp_flags" in packets.columns:
        syn = F.when(F.coalesce(F.col("tcp_flags"), F.lit(0)).bitwiseAND(F.lit(_SYN)) != 0, number)
        before = F.last(syn, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        opens = syn.isNotNull() & (before.isNull() | (syn != before))
        p = p.withColumns({"opens_": opens.cast("long"), "pos_": F.col("pos_") + syn.isNotNull().cast("long")})
        p = p.withColumn("conn", F.sum("opens_").over(w))
    else:
        p = p.withColumn("conn", F.lit(0).cast("long"))
    base = p.groupBy(*by, "conn").agg(F.min("pos_").alias("base_"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*by, "conn"]]
    both = p.filter(F.length("payload") > 0).alias("p").join(base.alias("r"), same)
    return both.select(*(F.col(f"p.{c}") for c in [*by, "conn"]), (F.col("pos_") - F.col("base_")).alias("offset"), "ts_us", "seq", "payload")


#: Reads the start of a stream's bytes: (bytes used up, messages as tuples, whether it reads on). It is called with all that is not used up yet.
Reader = Callable[[bytes], tuple[int, list[tuple], bool]]


def messages(packets: DataFrame, reader: Callable[[], Reader], schema: str, by: list[str] | None = None, most: int = MOST, head: int | None = None) -> DataFrame:
    """by, conn, nth (from 0), ts_us and the columns of ``schema`` (types long and binary, string): the messages of streams, as ``reader()`` reads one stream.

    ts_us is the time by which all bytes up to the message's end have been seen. ``head``: only segments that begin within the first bytes.
    """
    by = side_of(packets) if by is None else by
    s = placed(packets, by)
    if head is not None:
        s = s.filter(F.col("offset") < head)
    return cut(s, [*by, "conn"], reader, schema, most)


def cut(parts: DataFrame, keys: list[str], reader: Callable[[], Reader], schema: str, most: int = MOST) -> DataFrame:
    """The messages of streams whose parts (keys, offset, ts_us, seq, payload) may come in any order, twice, or overlap."""
    fields = [T.StructField("nth", T.LongType()), T.StructField("ts_us", T.LongType()), *T._parse_datatype_string(schema).fields]
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    types = [kinds[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, read, held, covered, at_us, nth, open_ = None, None, bytearray(), 0, 0, 0, False
        for batch in batches:
            rows, told = [], []
            key_columns = [batch.column(i).to_pylist() for i in range(len(keys))]
            for i, (key, offset, ts, payload) in enumerate(zip(zip(*key_columns, strict=True), *(batch.column(len(keys) + k).to_pylist() for k in range(3)), strict=True)):
                if own != key:
                    own, read, held, covered, at_us, nth, open_ = key, reader(), bytearray(), 0, ts, 0, True
                if not open_ or offset + len(payload) <= covered:
                    continue
                if offset > covered:
                    open_ = False
                    continue
                held += payload[covered - offset :]
                covered, at_us = offset + len(payload), max(at_us, ts)
                used, found, open_ = read(bytes(held))
                del held[:used]
                for m in found:
                    rows.append(i)
                    told.append((nth, at_us, *m))
                    nth += 1
                if len(held) > most:
                    open_ = False
                if not open_:
                    held = bytearray()
            if rows:
                kept = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns[: len(keys)], *(pa.array(c, t) for c, t in zip(zip(*told, strict=True), types, strict=True))], [*keys, *(f.name for f in fields)])

    s = parts.select(*keys, "offset", "ts_us", "payload", F.length("payload").alias("size_"), "seq")
    out = T.StructType([*(s.schema[k] for k in keys), *fields])
    return s.repartition(*keys).sortWithinPartitions(*keys, "offset", F.desc("size_"), "seq").mapInArrow(run, out)


def prefixed(size: int, least: int = 1, extra: int = 0) -> Callable[[], Reader]:
    """Messages after their own length in so many big-endian bytes; ``extra``: what the length does not count. A length below ``least`` ends the reading."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while at + size <= len(data):
            n = int.from_bytes(data[at : at + size], "big") + extra
            if n < least:
                return at, found, False
            if at + size + n > len(data):
                break
            found.append((data[at + size : at + size + n],))
            at += size + n
        return at, found, True

    return lambda: read


def bare_handshakes() -> Reader:
    """Messages of a handshake (kind, body) that comes without records, as over QUIC."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while at + 4 <= len(data) and at + 4 + (size := int.from_bytes(data[at + 1 : at + 4], "big")) <= len(data):
            found.append((data[at], data[at : at + 4 + size]))
            at += 4 + size
        return at, found, True

    return read


#: Types of TLS records: change of ciphers, handshake; and the longest record.
CHANGE, HANDSHAKE, LONGEST = 20, 22, (1 << 14) + 2048


def handshakes() -> Reader:
    """Messages of a TLS handshake (kind, body) joined over records, up to the change of ciphers or the first record of another type."""
    message = bytearray()

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while at + 5 <= len(data):
            n = int.from_bytes(data[at + 3 : at + 5], "big")
            if data[at] != HANDSHAKE or data[at + 1] != 3 or n > LONGEST:
                return at, found, False
            if at + 5 + n > len(data):
                break
            message.extend(data[at + 5 : at + 5 + n])
            at += 5 + n
            while len(message) >= 4 and len(message) >= 4 + (size := int.from_bytes(message[1:4], "big")):
                found.append((message[0], bytes(message[: 4 + size])))
                del message[: 4 + size]
        return at, found, len(message) <= MOST

    return read


#: The longest line before and of a banner, the longest packet, and the kind of a key exchange offer.
LINE, PACKET, OFFER = 8192, 35_000, 20


def shell() -> Reader:
    """A secure shell's banner and its offer of algorithms: ("banner", line) and ("offer", packet). Lines before the banner are passed over."""
    state = {"banner": False}

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while not state["banner"]:
            end = data.find(b"\n", at)
            if end < 0:
                return at, found, len(data) - at <= LINE
            line = data[at : end + 1]
            at = end + 1
            if line.startswith(b"SSH-"):
                state["banner"] = True
                found.append(("banner", line))
            elif len(line) > LINE:
                return at, found, False
        while at + 6 <= len(data):
            n = int.from_bytes(data[at : at + 4], "big")
            if not 2 <= n <= PACKET:
                return at, found, False
            if at + 4 + n > len(data):
                break
            packet = data[at : at + 4 + n]
            at += 4 + n
            if packet[5] == OFFER:
                return at, [*found, ("offer", packet)], False
        return at, found, True

    return read
