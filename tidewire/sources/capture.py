"""Capture files as tables of packets, and back.

Spark lists and reads the files (``binaryFile``), from any store that it knows; a task decodes its
files into rows batch by batch. Headers at fixed places are decoded here; payloads stay bytes, and
protocol fields are columns over them. Capture tools rotate files well below the 2 GB that a cell
holds; that is the unit of work here. ``pcap_source`` splits files of any size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net

#: File magics, as read little-endian, with the byte order and the nanoseconds a tick.
MAGICS = {0xA1B2C3D4: ("<", 1000), 0xD4C3B2A1: (">", 1000), 0xA1B23C4D: ("<", 1), 0x4D3CB2A1: (">", 1)}
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
#: IPv6 extension headers that the next header follows: hop-by-hop and destination options, routing.
OPTIONS = (0, 43, 60)
ROWS = 4096

#: What workers tell of frames: numbers and bytes; ``named`` makes text of them where it is asked for.
RAW = "source string, seq long, ts_ns long, cap_len long, len long, src_mac6 binary, dst_mac6 binary, ethertype int, vlan_id int, proto int, src_ip4 long, dst_ip4 long, src_ip6 binary, dst_ip6 binary, src_port int, dst_port int, tcp_flags int, tcp_seq long, ident int, frag_offset int, more_fragments boolean, payload binary"
#: The columns of decoded packets, in order; ts_us is ts_ns in whole microseconds.
COLUMNS = "source seq ts_ns cap_len len src_mac dst_mac ethertype vlan_id proto src_ip dst_ip src_ip4 dst_ip4 src_ip6 dst_ip6 src_port dst_port tcp_flags tcp_seq ident frag_offset more_fragments payload ts_us".split()


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(ts_ns, original length, bytes) of each packet of a pcap or pcapng file; a cut-off last one is left out."""
    if len(data) < 4:
        return
    magic = struct.unpack("<I", data[:4])[0]
    if magic in MAGICS:
        order, scale = MAGICS[magic]
        at = 24
        while at + 16 <= len(data):
            sec, part, size, whole = struct.unpack_from(order + "IIII", data, at)
            if at + 16 + size > len(data):
                return
            yield sec * 1_000_000_000 + part * scale, whole, data[at + 16 : at + 16 + size]
            at += 16 + size
    elif magic == SECTION:
        order, at, ticks = "<", 0, []
        while at + 12 <= len(data):
            kind = struct.unpack_from(order + "I", data, at)[0]
            if kind == SECTION:
                order = "<" if data[at + 8 : at + 12] == b"\x4d\x3c\x2b\x1a" else ">"
                ticks = []
            size = struct.unpack_from(order + "I", data, at + 4)[0]
            if size < 12 or at + size > len(data):
                return
            body = data[at + 8 : at + size - 4]
            if kind == INTERFACE:
                ticks.append(_tick(order, body[8:]))
            elif kind == PACKET:
                which, high, low, held, whole = struct.unpack_from(order + "IIIII", body)
                per = ticks[which] if which < len(ticks) else 1_000_000
                yield ((high << 32) | low) * 1_000_000_000 // per, whole, body[20 : 20 + held]
            at += size
    else:
        raise ValueError(f"no capture file: it begins with {data[:4].hex()}")


def _tick(order: str, options: bytes) -> int:
    """Ticks a second of an interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(order + "HH", options, at)
        if code == 9 and size:
            x = options[at + 4]
            return 1 << (x & 127) if x & 128 else 10**x
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


class Frames:
    """Ethernet frames in one buffer of bytes, told by numpy all at once: each step looks at the same place of every frame."""

    def __init__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.data, self.begin, self.end = data, begin, end
        self.n = len(begin)

    def octet(self, at: np.ndarray) -> np.ndarray:
        """The byte at a place; 0 beyond the data."""
        fine = (at >= 0) & (at < len(self.data))
        return np.where(fine, self.data[np.where(fine, at, 0)], 0).astype(np.int64) if len(self.data) else np.zeros(self.n, np.int64)

    def number(self, at: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(self.n, np.int64)
        for k in range(size):
            out = out << 8 | self.octet(at + k)
        return out

    def fixed(self, at: np.ndarray, size: int, there: np.ndarray) -> pa.Array:
        """So many bytes from a place; null where they are not there."""
        index = np.where(there[:, None], at[:, None] + np.arange(size), 0)
        raw = self.data[index] if len(self.data) else np.zeros((self.n, size), np.uint8)
        whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), self.n, [None, pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
        return pc.if_else(pa.array(there), whole, pa.nulls(self.n, pa.binary(size))).cast(pa.binary())

    def slices(self, at: np.ndarray, end: np.ndarray, there: np.ndarray) -> pa.Array:
        """The bytes from a place to another; null where there is no frame."""
        size = np.where(there, np.maximum(end - at, 0), 0)
        offsets = np.concatenate(([0], np.cumsum(size)))
        index = np.repeat(at - offsets[:-1], size) + np.arange(offsets[-1])
        raw = self.data[index].tobytes() if len(index) else b""
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)])
        return pc.if_else(pa.array(there), whole, pa.nulls(self.n, pa.large_binary())).cast(pa.binary())

    def columns(self) -> dict[str, pa.Array]:
        """Header fields; what is not there is null. Tags and IPv6 option headers are passed over, however many; padding behind a packet's own length is no payload."""
        begin, end = self.begin, self.end.copy()
        real = end - begin >= 14
        kind, at = np.where(real, self.number(begin + 12, 2), 0), begin + 14
        vlan, tagged = np.zeros(self.n, np.int64), np.zeros(self.n, bool)
        while (tag := real & np.isin(kind, (0x8100, 0x88A8)) & (end >= at + 4)).any():
            vlan = np.where(tag & ~tagged, self.number(at, 2) & 0x0FFF, vlan)
            tagged |= tag
            kind, at = np.where(tag, self.number(at + 2, 2), kind), np.where(tag, at + 4, at)
        four, six = real & (kind == 0x0800) & (end >= at + 20), real & (kind == 0x86DD) & (end >= at + 40)
        total, place = self.number(at + 2, 2), self.number(at + 6, 2)
        ident, source, target = self.number(at + 4, 2), self.number(at + 12, 4), self.number(at + 16, 4)
        size = self.number(at + 4, 2)
        six_at = at + 8
        proto = np.where(four, self.octet(at + 9), self.octet(at + 6))
        end = np.where(four & (total > 0), np.minimum(end, at + total), np.where(six & (size > 0), np.minimum(end, at + 40 + size), end))
        at = np.where(four, at + (self.octet(at) & 15) * 4, np.where(six, at + 40, at))
        while (option := six & np.isin(proto, OPTIONS) & (end >= at + 8)).any():
            proto, at = np.where(option, self.octet(at), proto), np.where(option, at + 8 + 8 * self.octet(at + 1), at)
        first = six | (four & (place & 0x1FFF == 0))
        ported = first & np.isin(proto, (6, 17)) & (end >= at + 8)
        ports = self.number(at, 2), self.number(at + 2, 2)
        tcp = ported & (proto == 6) & (end >= at + 20)
        seq, flags = self.number(at + 4, 4), self.octet(at + 13)
        at = np.where(tcp, at + (self.octet(at + 12) >> 4) * 4, np.where(ported & (proto == 17), at + 8, at))
        some = lambda x, there, kind: pa.array(x, kind, mask=~there)
        i32, i64 = pa.int32(), pa.int64()
        return {
            "src_mac6": self.fixed(begin + 6, 6, real), "dst_mac6": self.fixed(begin, 6, real), "ethertype": some(kind, real, i32), "vlan_id": some(vlan, tagged, i32), "proto": some(proto, four | six, i32),
            "src_ip4": some(source, four, i64), "dst_ip4": some(target, four, i64), "src_ip6": self.fixed(six_at, 16, six), "dst_ip6": self.fixed(six_at + 16, 16, six),
            "src_port": some(ports[0], ported, i32), "dst_port": some(ports[1], ported, i32), "tcp_flags": some(flags, tcp, i32), "tcp_seq": some(seq, tcp, i64),
            "ident": some(ident, four, i32), "frag_offset": some((place & 0x1FFF) * 8, four, i32), "more_fragments": some(place & 0x2000 != 0, four, pa.bool_()), "payload": self.slices(at, end, real),
        }


def table(source: pa.Array, seq: pa.Array, ts_ns: pa.Array, sizes: pa.Array | None, frames_: pa.Array) -> pa.RecordBatch:
    """Frames as a batch of ``RAW``; ``sizes`` are their original lengths (None: as they are)."""
    frames_ = frames_.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(frames_.buffers()[1], np.int64)[frames_.offset : frames_.offset + len(frames_) + 1]
    data = np.frombuffer(frames_.buffers()[2], np.uint8) if frames_.buffers()[2] else np.zeros(0, np.uint8)
    held = pa.array(np.diff(raw), pa.int64())
    columns = {"source": source, "seq": seq, "ts_ns": ts_ns, "cap_len": held, "len": held if sizes is None else sizes} | Frames(data, raw[:-1], raw[1:]).columns()
    names = [f.split()[0] for f in RAW.split(", ")]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """(source, seq, ts_ns, original length, frame) rows as a batch."""
    source, seq, ts, whole, data = zip(*rows, strict=True)
    return table(pa.array(source, pa.string()), pa.array(seq, pa.int64()), pa.array(ts, pa.int64()), pa.array(whole, pa.int64()), pa.array(data, pa.large_binary()))


def decode(frame: bytes) -> dict:
    """The fields of one frame by their names in ``RAW``; what is not there is left out."""
    row = _batch([("", 0, 0, len(frame), frame)]).to_pylist()[0]
    return {k: v for k, v in row.items() if v is not None and k not in ("source", "seq", "ts_ns", "cap_len", "len")}


def named(rows: DataFrame) -> DataFrame:
    """Rows of ``RAW`` as ``COLUMNS``. Addresses become text as columns, so that nothing is spent on text that is not asked for."""
    mac = lambda c: F.lower(F.regexp_replace(F.hex(c), "(..)(?=.)", "$1:"))
    text = {f"{x}_ip": net.ip_text(F.col(f"{x}_ip4"), F.col(f"{x}_ip6")) for x in ("src", "dst")} | {f"{x}_mac": mac(f"{x}_mac6") for x in ("src", "dst")}
    return rows.withColumns(text | {"ts_us": F.expr("(ts_ns - pmod(ts_ns, 1000)) DIV 1000")}).select(*COLUMNS)


def decoded(rows: DataFrame) -> DataFrame:
    """Packets of a table of frames (source, seq, ts_ns, data), such as a message queue delivers them; also of a stream. A null frame has no fields."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                source, seq, ts, data = batch.slice(k, ROWS).columns
                yield table(source, seq.cast(pa.int64()), ts.cast(pa.int64()), None, data)

    return named(rows.select(F.col("source").cast("string"), F.col("seq").cast("long"), F.col("ts_ns").cast("long"), "data").mapInArrow(run, RAW))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Packets of all capture files under the paths, a file a cell: any store of Spark's, files below 2 GB. Larger ones, and streams: ``pcap_source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for seq, (ts, whole, frame) in enumerate(frames(content.as_py() or b"")):
                    rows.append((path, seq, ts, whole, frame))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", "content")
    return named(files.mapInArrow(run, RAW))


def file_bytes(packets: DataFrame, per_file: int = 100_000, snap: int = 262_144) -> DataFrame:
    """Packets (ts_ns, len, data) as capture files of so many packets each: file, content.

    Files take packets in order of time within their partition; only one file's packets are held at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0
        head = struct.pack("<IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, snap, 1)

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{number:05d}.pcap"]), pa.array([head + b"".join(held)], pa.binary())], ["file", "content"])

        for batch in batches:
            for ts, whole, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cut = (data or b"")[:snap]
                held += [struct.pack("<IIII", ts // 1_000_000_000, ts % 1_000_000_000, len(cut), whole), cut]
                n += 1
                if n == per_file:
                    yield file()
                    number, held, n = number + 1, [], 0
        if held:
            yield file()

    return packets.select("ts_ns", "len", "data").sortWithinPartitions("ts_ns").mapInArrow(run, "file string, content binary")


#: Ports of DNS, of its multicast kind, and of link-local name resolution.
DNS_PORTS = (53, 5353, 5355)


def _u16(c: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(c, at + 1, 2)), 16, 10).cast("int")


def dns(packets: DataFrame) -> DataFrame:
    """Rows with DNS over UDP (port 53; 5353 and 5355 of the link-local kinds), with the columns of ``dns_message``. Over TCP: protocols.dns_streams."""
    return dns_message(packets.filter("proto = 17").filter(F.col("src_port").isin(*DNS_PORTS) | F.col("dst_port").isin(*DNS_PORTS)))


def dns_message(messages: DataFrame) -> DataFrame:
    """Rows whose payload is a DNS message: id, whether a response, rcode, counts, and the first question's name, all of it up to the zero byte or a pointer."""
    p = messages.filter(F.length("payload") >= 12)
    flags, body = _u16(F.col("payload"), 2), F.col("payload")
    begin = F.struct(F.lit(12).alias("at"), F.array().cast("array<string>").alias("labels"))

    def label(a: Column, _: Column) -> Column:
        n = F.coalesce(F.conv(F.hex(F.substring(body, a["at"] + 1, F.lit(1))), 16, 10).cast("int"), F.lit(0))
        return F.when((n > 0) & (n < 64), F.struct((a["at"] + 1 + n).alias("at"), F.array_append(a["labels"], F.substring(body, a["at"] + 2, n).cast("string")).alias("labels"))).otherwise(a)

    # a name has 127 labels at most, each of two bytes or more
    most = F.least(F.lit(127), F.greatest(F.lit(1), F.ceil((F.length("payload") - 12) / 2).cast("int")))
    labels = F.aggregate(F.sequence(F.lit(1), most), begin, label, lambda a: a["labels"])
    return p.select("*", _u16(body, 0).alias("dns_id"), (flags.bitwiseAND(F.lit(0x8000)) != 0).alias("dns_response"), flags.bitwiseAND(F.lit(15)).alias("dns_rcode"), _u16(body, 6).alias("dns_answers"), F.lower(F.array_join(labels, ".")).alias("dns_qname"))


def http(packets: DataFrame) -> DataFrame:
    """Rows whose payload begins an HTTP/1 message: method, path, host, agent, status, from its head, up to the first empty line."""
    text = F.substring_index(F.decode("payload", "ISO-8859-1"), "\r\n\r\n", 1)
    p = packets.withColumn("http_", text).filter(F.col("http_").rlike(r"^(?:(?:GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH|CONNECT) \S+ HTTP/1|HTTP/1\.[01] \d{3})"))
    get = lambda pattern: F.nullif(F.regexp_extract("http_", pattern, 1), F.lit(""))
    return p.select("*", get(r"^([A-Z]+) ").alias("http_method"), get(r"^[A-Z]+ (\S+) ").alias("http_path"), F.lower(get(r"(?i)\r\nHost: *([^\r\n]+)")).alias("http_host"), get(r"(?i)\r\nUser-Agent: *([^\r\n]+)").alias("http_agent"), get(r"^HTTP/1\.[01] (\d{3})").cast("int").alias("http_status")).drop("http_")


def arp(packets: DataFrame) -> DataFrame:
    """Rows of ARP over Ethernet: operation, sender's and target's addresses."""
    p = packets.filter("ethertype = 2054").filter(F.length("payload") >= 28)
    body = F.col("payload")
    mac = lambda at: F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.hex(F.substring(body, i + at + 1, F.lit(1)))), ":"))
    ip = lambda at: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.hex(F.substring(body, i + at + 1, F.lit(1))), 16, 10)), ".")
    oper = _u16(body, 6)
    return p.select("seq", "ts_us", F.when(oper == 1, "request").when(oper == 2, "reply").otherwise("other").alias("oper"), mac(8).alias("mac"), ip(14).alias("ip"), mac(18).alias("target_mac"), ip(24).alias("target_ip"))
