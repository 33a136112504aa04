import random
import struct

from tidewire.operators import retention
from tidewire.sources import decoders


def _hello(name: bytes) -> bytes:
    ext = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    exts = ext(0, struct.pack(">HBH", len(name) + 3, 0, len(name)) + name) + ext(16, b"\x00\x03\x02h2") + ext(10, struct.pack(">HHH", 4, 29, 23)) + ext(11, b"\x01\x00")
    body = struct.pack(">H", 0x0303) + bytes(32) + b"\x00" + struct.pack(">HHH", 4, 0x0A0A, 4865) + b"\x01\x00" + struct.pack(">H", len(exts)) + exts
    message = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack(">H", len(message)) + message


def test_client_hello(spark):
    whole = _hello(b"Login.Evil.Example")
    rows = spark.createDataFrame([(1, 6, bytearray(whole)), (2, 6, bytearray(whole[:60])), (3, 6, bytearray(b"")), (4, 6, None), (5, 17, bytearray(whole))], "seq long, proto long, payload binary")
    got = decoders.tls(rows).collect()
    assert [(r.seq, r.sni, r.alpn, r.ciphers, r.curves, r.formats) for r in got] == [(1, "login.evil.example", "h2", [2570, 4865], [29, 23], [0])]
    import hashlib

    assert got[0].ja3 == hashlib.md5(b"771,4865,0-16-10-11,29-23,0").hexdigest()


def test_icmp_errors_and_adverts(spark):
    inner = struct.pack(">BBHHHBBHII", 0x45, 0, 28, 1, 0, 64, 17, 0, 5, 6) + struct.pack(">HHHH", 1000, 53, 8, 0)
    na = bytes([136, 0, 0, 0, 0x20, 0, 0, 0]) + bytes(15) + b"\x50" + b"\x02\x01" + bytes([0xBB] * 6)
    rows = spark.createDataFrame([(1, 1, 1, bytearray(b"\x03\x03" + bytes(6) + inner)), (2, 2, 1, bytearray(b"\x08\x00" + bytes(6))), (3, 3, 58, bytearray(na)), (4, 4, 58, None)], "seq long, ts_us long, proto long, payload binary")
    r = decoders.icmp(rows).collect()
    assert [(x.seq, x.icmp_kind, x.about_proto, x.about_src_ip4, x.about_dst_ip4, x.about_src_port, x.about_dst_port) for x in r] == [(1, "port_unreachable", 17, 5, 6, 1000, 53)]
    a = decoders.neighbour_adverts(rows).collect()
    assert [(x.seq, x.ip, x.mac, x.solicited, x.override) for x in a] == [(3, "0" * 30 + "50", "bb:bb:bb:bb:bb:bb", False, True)]


def test_ring_before_a_trigger(spark):
    rng = random.Random(2)
    rows = [(i, 0, rng.randrange(0, 50_000_000), rng.randrange(1, 100)) for i in range(200)]
    at, most = 30_000_000, 700
    got = retention.around_trigger(spark.createDataFrame(rows, "seq long, source_idx long, ts_us long, len long"), spark.createDataFrame([(0, at), (0, at + 5)], "source_idx long, ts_us long"), most_bytes=most)
    want, held = {r[0] for r in rows if r[2] >= at}, 0
    for r in sorted((r for r in rows if r[2] < at), key=lambda r: (-r[2], -r[0])):
        held += r[3]
        if held > most:
            break
        want.add(r[0])
    assert {r.seq for r in got.collect()} == want


def test_rotation_and_retention(spark):
    rows = spark.createDataFrame([(i, 0, i * 1_000_000, 40) for i in range(10)], "seq long, source_idx long, ts_us long, len long")
    files = [r.file for r in retention.rotated(rows, most_bytes=100, period_us=8_000_000).orderBy("seq").collect()]
    assert files == ["0-0-0"] * 3 + ["0-0-1"] * 2 + ["0-0-2"] * 3 + ["0-1-0"] * 2
    held = spark.createDataFrame([(0, "a", 1, 10), (0, "b", 2, 10), (0, "c", 3, 50)], "source_idx long, file string, end_us long, bytes long")
    assert {r.file for r in retention.retained(held, most_files=2).collect()} == {"b", "c"}
    assert {r.file for r in retention.retained(held, most_bytes=20).collect()} == {"c"}
