"""Header compression by its published examples, and header blocks out of segments."""

import struct

import pytest

from tests.test_streams import sent, table
from tidewire.sources import http2


def test_code_is_complete():
    """All codes together fill the space of codes but for the one that ends strings."""
    assert len(http2._CODES) == 256 and sum(1 << 30 - bits for bits, _ in http2._CODES) == (1 << 30) - 1
    assert http2.huffman(bytes.fromhex("f1e3c2e5f23a6ba0ab90f4ff")) == b"www.example.com"
    for bad in ("ffffffff", "f1e3c2e5f23a6ba0ab90f4fe"):
        with pytest.raises(ValueError):
            http2.huffman(bytes.fromhex(bad))


def test_published_requests():
    t = http2.Table()
    base = [(":method", "GET"), (":scheme", "http"), (":path", "/"), (":authority", "www.example.com")]
    assert t.read(bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff")) == base
    assert t.read(bytes.fromhex("828684be5886a8eb10649cbf")) == [*base, ("cache-control", "no-cache")]
    got = t.read(bytes.fromhex("828785bf408825a849e95ba97d7f8925a849e95bb8e8b4bf"))
    assert got == [(":method", "GET"), (":scheme", "https"), (":path", "/index.html"), (":authority", "www.example.com"), ("custom-key", "custom-value")]
    assert t.size == 164


def test_published_responses_evict():
    t = http2.Table(256)
    got = t.read(bytes.fromhex("488264025885aec3771a4b6196d07abe941054d444a8200595040b8166e082a62d1bff6e919d29ad171863c78f0b97c8e9ae82ae43d3"))
    assert got == [(":status", "302"), ("cache-control", "private"), ("date", "Mon, 21 Oct 2013 20:13:21 GMT"), ("location", "https://www.example.com")] and t.size == 222
    assert t.read(bytes.fromhex("4883640effc1c0bf"))[0] == (":status", "307") and t.size == 222


def frame(kind, flags, stream, body):
    return len(body).to_bytes(3, "big") + bytes([kind, flags]) + struct.pack(">I", stream) + body


def plain(name, value):
    return b"\x00" + bytes([len(name)]) + name.encode() + bytes([len(value)]) + value.encode()


CLIENT = (
    http2.PREFACE + frame(4, 0, 0, b"") + frame(1, 5, 1, bytes.fromhex("828684418cf1e3c2e5f23a6ba0ab90f4ff"))
    + frame(1, 0x29, 3, b"\x02\0\0\0\0\x10" + bytes.fromhex("828684be") + b"\0\0") + frame(9, 4, 3, bytes.fromhex("5886a8eb10649cbf"))
    + frame(1, 4, 5, b"\x83" + plain(":path", "/pkg.Service/Call") + plain("content-type", "application/grpc+proto")) + frame(0, 1, 5, b"x" * 40)
)


@pytest.mark.parametrize("size", [1, 17, 4000])
def test_blocks_out_of_segments(spark, size):
    got = http2.http2(table(spark, sent(CLIENT, 77, size=size, shuffle=size))).orderBy("nth").collect()
    assert [(r.stream, r.method, r.path, r.authority, r.ends) for r in got] == [(1, "GET", "/", "www.example.com", 1), (3, "GET", "/", "www.example.com", 1), (5, "POST", "/pkg.Service/Call", None, 0)]
    assert got[1].headers["cache-control"] == "no-cache" and (got[2].grpc_service, got[2].grpc_method) == ("pkg.Service", "Call")


def test_answers_and_other_streams(spark):
    server = frame(4, 0, 0, b"") + frame(1, 4, 5, b"\x88" + plain("content-type", "application/grpc")) + frame(1, 5, 5, plain("grpc-status", "7"))
    got = http2.http2(table(spark, sent(server, 5, size=9))).orderBy("nth").collect()
    assert [(r.status, r.grpc_status, r.ends, r.grpc_method) for r in got] == [(200, None, 0, None), (None, 7, 1, None)]
    assert http2.http2(table(spark, sent(b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", 5))).collect() == []
    broken = http2.PREFACE + frame(1, 5, 1, b"\xff\xff\xff") + frame(1, 5, 3, b"\x82")
    assert http2.http2(table(spark, sent(broken, 5))).collect() == []
