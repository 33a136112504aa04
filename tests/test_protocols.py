import struct

from pyspark.sql import functions as F

from tidewire.functions import net
from tidewire.operators import correlate, reports
from tidewire.sources import decoders, formats, protocols


def test_published_example_of_ja4(spark):
    ciphers = "1301 1302 1303 c02b c02f c02c c030 cca9 cca8 c013 c014 009c 009d 002f 0035"
    extensions = "001b 0000 0033 0010 4469 0017 002d 000d 0005 0023 0012 002b ff01 000b 000a 0015"
    signatures = "0403 0804 0401 0503 0805 0501 0806 0601"
    codes = lambda text: [int(x, 16) for x in text.split()]
    row = (0x0303, [0x2A2A, 0x0304, 0x0303], [0x1A1A, *codes(ciphers)], [0xFAFA, *codes(extensions)], codes(signatures), "h2")
    schema = "version int, versions array<int>, ciphers array<int>, extensions array<int>, signatures array<int>, alpn string"
    bare = (0x0301, None, None, None, None, None)
    d = spark.createDataFrame([row, bare], schema)
    got = [r[0] for r in d.select(net.ja4(*(F.col(c) for c in d.columns))).collect()]
    assert got == ["t13d1516h2_8daaf6152771_e5627efa2ab1", "t10i000000_000000000000_000000000000"]


def test_hello_tells_versions_and_signatures():
    ext = lambda kind, body: struct.pack(">HH", kind, len(body)) + body
    exts = ext(43, bytes.fromhex("0403040303")) + ext(13, bytes.fromhex("000404030804"))
    body = b"\x03\x03" + bytes(32) + b"\x00" + b"\x00\x02\x13\x01" + b"\x01\x00" + struct.pack(">H", len(exts)) + exts
    hello = b"\x16\x03\x01" + struct.pack(">H", len(body) + 4) + b"\x01" + len(body).to_bytes(3, "big") + body
    got = decoders.client_hello(hello)
    assert got["versions"] == [0x0304, 0x0303] and got["signatures"] == [0x0403, 0x0804]


def test_answers_of_broken_messages():
    head = struct.pack(">HHHHHH", 7, 0x8180, 1, 2, 0, 0)
    name = b"\x01A\x00"
    good = b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 9, 4) + bytes([10, 0, 0, 1])
    assert protocols.answers(head + name + b"\0\1\0\1" + good) == [(7, "a", "a", 1, 9, "10.0.0.1")]  # the second one is missing
    assert protocols.answers(head + name + b"\0\1\0\1" + good + good[:-1]) == [(7, "a", "a", 1, 9, "10.0.0.1")]
    assert protocols.answers(head + b"\xc0\x0c\0\1\0\1" + good) == []  # a pointer at itself
    assert protocols.answers(head[:2] + b"\x01\x00" + head[4:] + name + b"\0\1\0\1" + good) == []  # a question
    assert protocols.answers(b"") == []
    other = b"\xc0\x0c" + struct.pack(">HHIH", 16, 1, 9, 2) + b"\x01x"
    assert protocols.answers(head + name + b"\0\1\0\1" + other) == [(7, "a", "a", 16, 9, None)]


def test_null_empty_and_cut_payloads(spark):
    rows = [(p, s, d, e, b) for p, s, d, e in ((17, 53, 1, 0), (6, 1, 22, 0), (17, 68, 67, 0), (None, None, None, 35020), (17, 123, 1, 0), (None,) * 4) for b in (None, bytearray(), bytearray(b"\x02"), bytearray(b"\xff" * 300))]
    p = spark.createDataFrame(rows, "proto int, src_port int, dst_port int, ethertype int, payload binary")
    for f in (protocols.dns_answers, protocols.ssh, protocols.ssh_kex, protocols.dhcp, protocols.stun, protocols.wireguard):
        assert f(p).count() == 0, f
    assert protocols.ntp(p).count() == 1
    assert [tuple(r) for r in protocols.lldp(p).select("chassis", "port", "ttl", "system_name").collect()] == [(None,) * 4] * 4
    assert protocols.dns_answers(p.limit(0)).columns[-1] == "answer_value"


def test_inventory_takes_the_latest_of_all_sources(spark):
    rows = [("m", 1, "arp", "10.0.0.1", None), ("m", 5, "dhcp", None, "b"), ("m", 5, "dhcp", None, "c"), ("m", 3, "arp", "10.0.0.9", "z"), ("n", 2, "arp", None, None), (None, 9, "arp", "x", "y")]
    got = reports.inventory(spark.createDataFrame(rows, "mac string, ts_us long, source string, ip string, name string"), "mac", ["ip", "name"])
    assert [tuple(r) for r in got.orderBy("mac").collect()] == [("m", 1, 5, ["arp", "dhcp"], "10.0.0.9", "c"), ("n", 2, 2, ["arp"], None, None)]


def test_fingerprints_and_messages(spark):
    rows = spark.createDataFrame([(1, "AA", None), (2, None, "bb"), (3, "aa", "bb")], "id int, ja3 string, ja4 string")
    bad = spark.createDataFrame([("aa", 3), ("AA", 5), (None, 9)], "fingerprint string, reputation int")
    got = correlate.indicator_fingerprints(rows, ["ja3", "ja4"], bad)
    assert sorted((r.id, r.fingerprint_kind, r.reputation) for r in got.collect()) == [(1, "ja3", 5), (3, "ja3", 5)]
    f = spark.createDataFrame([("k", "info", 1, None, {}, {"x": float("nan")})], "kind string, severity string, ts_us long, key string, observations map<string,string>, metrics map<string,double>")
    m = formats.messages(f, {"log": formats.telemetry_log(f)}).first()
    assert m.key == "k" and [(h.key, bytes(h.value)) for h in m.headers] == [("kind", b"k"), ("severity", b"info")]
    assert m.log == '{"timeUnixNano":"1000","severityNumber":9,"severityText":"INFO","body":{"stringValue":"k"},"attributes":[{"key":"x","value":{}}]}'
