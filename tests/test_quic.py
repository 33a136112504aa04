"""QUIC Initial packets: the published example of packet protection, and hellos over several packets."""

import pytest
from pyspark.sql import functions as F

from tests.test_streams import hello
from tidewire.sources import quic

CID = bytes.fromhex("8394c8f03e515708")
#: The published example's CRYPTO frame and what its keys and its protected header are.
FRAME = bytes.fromhex(
    "060040f1010000ed0303ebf8fa56f12939b9584a3896472ec40bb863cfd3e86804fe3a47f06a2b69484c00000413011302010000c000000010000e00000b6578616d706c652e636f6d"
    "ff01000100000a00080006001d0017001800100007000504616c706e000500050100000000003300260024001d00209370b2c9caa47fbabaf4559fedba753de171fa71f50f1ce15d43"
    "e994ec74d748002b0003020304000d0010000e0403050306030203080408050806002d00020101001c00024001003900320408ffffffffffffffff05048000ffff07048000ffff0801"
    "100104800075300901100f088394c8f03e51570806048000ffff"
)


def sealed(spark, payload, number, cid=CID, version=1, size=4, first=0xC0, side=b"client in"):
    """A protected Initial packet by Spark's ciphers."""
    key, iv, mask_key = quic.keys(version, cid, side)
    kind = first | quic.VERSIONS[version][2] << 4 | size - 1
    head = bytes([kind]) + version.to_bytes(4, "big") + bytes([len(cid)]) + cid + b"\0\0" + (0x4000 | size + len(payload) + 16).to_bytes(2, "big")
    coded = number.to_bytes(size, "big")
    nonce = iv[:8] + (int.from_bytes(iv[8:], "big") ^ number).to_bytes(4, "big")
    row = spark.range(1).select(F.aes_encrypt(F.lit(payload), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(nonce), F.lit(head + coded)).alias("x"))
    rest = coded + bytes(row.first().x)[12:]
    mask = bytes(spark.range(1).select(F.aes_encrypt(F.lit(rest[4:20]), F.lit(mask_key), F.lit("ECB")).alias("x")).first().x)[:5]
    return bytes([head[0] ^ mask[0] & 15]) + head[1:] + bytes(a ^ b for a, b in zip(rest[:size], mask[1:], strict=False)) + rest[size:]


def table(spark, *datagrams):
    rows = [(i, i, 17, 1, 5000, 2, 443, d) for i, d in enumerate(datagrams)]
    return spark.createDataFrame(rows, "seq long, ts_us long, proto int, src_ip4 long, src_port int, dst_ip4 long, dst_port int, payload binary")


def frame(offset, data):
    return b"\x06" + (0x80000000 | offset).to_bytes(4, "big") + (0x4000 | len(data)).to_bytes(2, "big") + data


def test_keys_of_the_published_example():
    assert [k.hex() for k in quic.keys(1, CID)] == ["1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2"]
    assert [k.hex() for k in quic.keys(1, CID, b"server in")] == ["cf3a5331653c364c88f0f379b6067e37", "0ac1493ca1905853b0bba03e", "c206b8d9b9f0f37644430b490eeaa314"]


def test_header_of_the_published_example(spark):
    assert len(FRAME) == 245
    packet = sealed(spark, FRAME + bytes(1162 - len(FRAME)), 2)
    assert len(packet) == 1200 and packet[:38].hex() == "c000000001088394c8f03e5157080000449e7b9aec34d1b1c98dd7689fb8ec11d242b123dc9b"
    assert packet[-16:].hex() == "e221af44860018ab0856972e194cd934"
    got = quic.hellos(table(spark, packet)).collect()
    assert [(r.sni, r.alpn, bytes(r.connection)) for r in got] == [("example.com", "alpn", CID)]


@pytest.mark.parametrize("version", quic.VERSIONS)
def test_hello_over_packets(spark, version):
    message = hello("quic.example")
    seal = lambda payload, n, **more: sealed(spark, payload, n, version=version, **more)
    one = seal(b"\x01" + frame(100, message[100:300]) + bytes(40), 1, size=2)
    two = seal(bytes(20) + frame(0, message[:100]) + b"\x02\x05\x00\x00\x00" + frame(300, message[300:]), 0, size=1)
    answer = seal(frame(0, message), 0, side=b"server in")
    broken = one[:-1] + bytes([one[-1] ^ 1])
    got = quic.hellos(table(spark, one, two + one, answer, b"\xc0" * 100, b"", broken)).collect()
    assert [(r.sni, r.ja4[:4], bytes(r.connection), r.ts_us) for r in got] == [("quic.example", "q12d", CID, 1)]
    assert quic.hellos(table(spark, one, broken)).collect() == []


def test_odd_datagrams():
    for data in (b"", b"\xc0", b"\xc0\0\0\0\1", b"\xc0\0\0\0\1\x14" + bytes(30), b"\xff" * 80, b"\xd0\0\0\0\1\0\0\x40"):
        assert quic.initials(data) == []
    assert quic.crypto(b"\x06\x00\x40") == quic.crypto(b"\x1c\x00") == quic.crypto(b"\x02") == []
