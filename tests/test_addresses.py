import ipaddress
import random

from pyspark.sql import functions as F

from tidewire.functions import net
from tidewire.operators import correlate, filters, flows
from tidewire.sources import capture

PACKETS = "seq long, ts_us long, proto long, src_ip4 long, dst_ip4 long, src_ip6 binary, dst_ip6 binary, src_port int, dst_port int, len long"
SIX = [ipaddress.IPv6Address(x).packed for x in ("2001:db8::1", "2001:db8::2", "fe80::1")]


def test_ip6_spellings(spark):
    rng = random.Random(1)
    texts = ["::", "::1", "1::", "2001:db8::ff00:42:8329", "::ffff:192.0.2.128", "1:2:3:4:5:6:7:8", "1:0:0:2:0:0:0:3", "1:0:0:2:3:0:0:4", "FE80::A", "1:2:3:4:5:6:7::", "0:0:3:4:5:6:7:8"]
    texts += [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128) & rng.getrandbits(128))) for _ in range(50)]
    texts += [":".join(rng.choice(["0", "0", "ab", "1"]) for _ in range(8)) for _ in range(100)]
    bad = ["", ":", "1:2", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "g::", "1.2.3.4", "::1.2.3.400", ":1::2", None]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    got = df.select("t", net.ip6_bytes(F.col("t")).alias("b")).withColumn("back", net.ip6_text(F.col("b"))).collect()
    for r in got[: len(texts)]:
        assert r.b is not None and bytes(r.b) == ipaddress.IPv6Address(r.t).packed and r.back == str(ipaddress.IPv6Address(int.from_bytes(r.b, "big"))).replace("::ffff:192.0.2.128", "::ffff:c000:280"), r
    assert all(r.b is None for r in got[len(texts) :])


def test_ip6_flows_stay_apart(spark):
    a, b, c = map(bytearray, SIX)
    rows = [(1, 0, 17, None, None, a, b, 1000, 53, 60), (2, 10, 17, None, None, b, a, 53, 1000, 90), (3, 20, 17, None, None, c, b, 1000, 53, 70), (4, 5, 17, 5, 6, None, None, 1000, 53, 10), (5, 6, 17, None, None, None, None, 1, 2, 10)]
    p = spark.createDataFrame(rows, PACKETS)
    got = {(bytes(r.a_ip6 or b""), r.a_ip4): (r.packets_initiator, r.packets_responder, r.bytes_initiator) for r in flows.flows(p).collect()}
    assert got == {(SIX[0], None): (1, 1, 60), (SIX[1], None): (1, 0, 70), (b"", 5): (1, 0, 10)}
    assert flows.flows(p, directional=True).count() == 4
    assert {r.seq: (r.start_us, r.end_us) for r in flows.tracked(p).collect()} == {1: (0, 10), 2: (0, 10), 3: (20, 20), 4: (5, 5)}
    keep = filters.network("2001:db8::/64", "src") & ~filters.host("2001:db8::2", "src")
    assert [r.seq for r in filters.select(p, keep).collect()] == [1]


def test_ip6_frames(spark):
    udp = (1000).to_bytes(2, "big") + (53).to_bytes(2, "big") + b"\0\x0a\0\0hi"
    frame = bytes(12) + b"\x86\xdd" + b"\x60\0\0\0" + (8 + len(udp)).to_bytes(2, "big") + b"\0\x40" + SIX[0] + SIX[1] + bytes([17, 0]) + bytes(6) + udp + b"padding"
    r = capture.decoded(spark.createDataFrame([("x", 1, 1_704_740_155_369_872_000, bytearray(frame)), ("x", 2, 3000, None)], "source string, seq long, ts_ns long, data binary")).orderBy("seq").collect()
    assert (r[0].proto, r[0].src_port, r[0].dst_port, bytes(r[0].payload), bytes(r[0].src_ip6), r[0].dst_ip, r[0].ts_us) == (17, 1000, 53, b"hi", SIX[0], "2001:db8::2", 1_704_740_155_369_872)
    assert r[1].proto is None and r[1].cap_len == 0


def test_periods_that_hold_each_other(spark):
    rng = random.Random(3)
    periods = [(rng.randrange(3), b := rng.randrange(300), b + rng.choice([0, 3, 40, 200, -5]), i) for i in range(80)]
    periods = list({(k, b): (k, b, e, i) for k, b, e, i in periods}.values())
    rows = [(i, rng.randrange(4), rng.randrange(-10, 520)) for i in range(400)]
    got = correlate.within(spark.createDataFrame(rows, "seq long, k long, ts_us long"), spark.createDataFrame(periods, "k long, b long, e long, id long"), ["k"], "b", "e", ["id"], stretch_us=50)
    want = {s: max(((b, i) for k2, b, e, i in periods if k2 == k and b <= t <= e), default=(0, None))[1] for s, k, t in rows}
    assert {r.seq: r.id for r in got.collect()} == want
