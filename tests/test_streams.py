"""Messages out of segments: cut anywhere, out of order, twice, over records, behind banners, on reused ends."""

import random
import struct

import pytest

from tidewire.sources import capture, decoders, protocols, streams

SCHEMA = "seq long, ts_us long, proto int, src_ip4 long, src_port int, dst_ip4 long, dst_port int, tcp_flags int, tcp_seq long, payload binary"
ENDS = (1, 4000, 2, 443)


def hello(name):
    host = name.encode()
    ext = struct.pack(">HHHBH", 0, len(host) + 5, len(host) + 3, 0, len(host)) + host + struct.pack(">HH", 21, 300) + b"p" * 300
    body = b"\x03\x03" + b"\0" * 32 + b"\0" + b"\0\x02\x13\x01" + b"\x01\0" + struct.pack(">H", len(ext)) + ext
    return b"\x01" + len(body).to_bytes(3, "big") + body


def records(message, *cuts):
    parts = [message[a:b] for a, b in zip([0, *cuts], [*cuts, len(message)], strict=True)]
    return b"".join(b"\x16\x03\x01" + struct.pack(">H", len(p)) + p for p in parts)


def sent(data, isn, start=0, size=50, ends=ENDS, syn=True, shuffle=None):
    """Segments of a stream: (ts_us, ends, flags, number, payload)."""
    rows = [(start, ends, 2, isn, b"")] if syn else []
    parts = [(start + 1 + i, ends, 24, (isn + 1 + i * size) % (1 << 32), data[i * size : (i + 1) * size]) for i in range((len(data) + size - 1) // size)]
    if shuffle is not None:
        times = [p[0] for p in parts]
        random.Random(shuffle).shuffle(times)
        parts = [(t, *p[1:]) for t, p in zip(times, parts, strict=True)] + parts[:2]
    return rows + parts


def table(spark, *streams_):
    rows = sorted(r for s in streams_ for r in s)
    return spark.createDataFrame([(i, t, 6, *ends, flags, number, data) for i, (t, ends, flags, number, data) in enumerate(rows)], SCHEMA).repartition(3)


def test_hello_over_records_segments_and_the_end_of_numbers(spark):
    data = records(hello("a.example"), 10, 200)
    for p in (table(spark, sent(data, (1 << 32) - 120, shuffle=1)), table(spark, sent(data, 5, size=10_000)), table(spark, sent(data, 5, syn=False, shuffle=3))):
        assert [(r.sni, r.src_port, len(r.ja3), r.ech) for r in decoders.tls_streams(p).collect()] == [("a.example", 4000, 32, False)]
    whole = table(spark, sent(data, 5, size=10_000))
    assert [r.sni for r in decoders.tls(whole).collect()] == ["a.example"]
    assert decoders.tls(table(spark, sent(data[:150], 5, size=10_000))).collect() == []
    assert decoders.tls_streams(table(spark, sent(data[:-1], 5))).collect() == []


def test_reused_ends(spark):
    p = table(spark, sent(records(hello("one.example")), 77, 0), sent(records(hello("two.example"), 9), 3_000_000_000, 10_000, shuffle=2), sent(records(hello("three.example")), 12, 20_000, size=7))
    assert [(r.conn, r.sni) for r in decoders.tls_streams(p).orderBy("conn").collect()] == [(1, "one.example"), (2, "two.example"), (3, "three.example")]


def test_gap_ends_a_stream(spark):
    data = records(hello("a.example"))
    rows = [r for i, r in enumerate(sent(data, 5)) if i != 3]
    assert decoders.tls_streams(table(spark, rows)).collect() == []


def offer():
    names = [b"kex-a,kex-b", b"key", b"c1", b"d,e", b"mac", b"mac-s", b"none", b"none,zlib", b"", b""]
    body = b"\x04\x14" + b"r" * 16 + b"".join(struct.pack(">I", len(n)) + n for n in names) + b"\0" * 9
    return struct.pack(">I", len(body)) + body


@pytest.mark.parametrize("size", [1, 20, 63, 10_000])
def test_shell_offer_behind_its_banner(spark, size):
    data = b"a line before\r\nSSH-2.0-server_1 note\r\n" + offer() + b"later bytes"
    told = {r.what: r for r in protocols.ssh_streams(table(spark, sent(data, 9, size=size, shuffle=size))).collect()}
    assert told["banner"].ssh_software == "server_1" and told["banner"].ssh_comment == "note"
    assert told["offer"].ssh_lists[0] == ["kex-a", "kex-b"] and told["offer"].hassh and told["offer"].hassh_server != told["offer"].hassh


def question(n, name):
    return struct.pack(">HHHHHH", n, 0x8180, 1, 1, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0\0\x01\0\x01" + b"\xc0\x0c\0\x01\0\x01\0\0\0\x3c\0\x04\x0a\0\0\x01"


@pytest.mark.parametrize("size", [1, 13, 4000])
def test_names_over_tcp(spark, size):
    asked = [question(i, f"h{i}.example") for i in range(5)]
    data = b"".join(struct.pack(">H", len(q)) + q for q in asked)
    m = protocols.dns_streams(table(spark, sent(data, 1 << 31, size=size, ends=(2, 53, 1, 4000), shuffle=4)))
    assert [(r.nth, r.dns_id, r.dns_qname) for r in capture.dns_message(m).orderBy("nth").collect()] == [(i, i, f"h{i}.example") for i in range(5)]
    assert sorted((r.dns_id, r.answer_value) for r in protocols.answers_of(m).collect()) == [(i, "10.0.0.1") for i in range(5)]


def test_long_stream_wraps_twice(spark):
    """Places are sums of steps, so more than 2^32 bytes keep their order."""
    jump = 1 << 30
    rows = [(0, ENDS, 2, 0, b"")] + [(i + 1, ENDS, 24, (1 + i * jump) % (1 << 32), b"xy") for i in range(10)]
    got = [r.offset for r in streams.placed(table(spark, rows)).orderBy("offset").collect()]
    assert got == [i * jump for i in range(10)]


def test_empty(spark):
    assert decoders.tls_streams(table(spark, sent(b"", 1)).limit(0)).collect() == []
    assert protocols.ssh_streams(table(spark, sent(b"no shell\n" * 2000, 1, size=5000))).collect() == []
