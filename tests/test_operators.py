import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidewire.functions import net
from tidewire.operators import correlate, detect, filters, flows, folds, layers, reports
from tidewire.plans import queries
from tidewire.sources import capture, formats

US = 1_000_000
PACKET = "seq long, ts_us long, proto long, src_ip4 long, src_port long, dst_ip4 long, dst_port long, len long"


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_addresses_and_names(spark):
    r = one(spark, net.ip4_text(F.lit(3_232_235_777)), net.ip4_number(F.lit("192.168.1.1")), net.ip4_number(F.lit("1.2.3.400")), net.second_level(F.lit("A.b.Example.COM.")), net.label_suffixes(F.lit("a.b.c")), net.is_doh_resolver(F.lit("DNS.google.")))
    assert list(r) == ["192.168.1.1", 3_232_235_777, None, "example", ["a.b.c", "b.c", "c"], True]
    assert net.cidr_range("10.1.2.3/8") == (10 << 24, (11 << 24) - 1)


@pytest.mark.parametrize("pattern,text,hit", [("*.ex.com", "a.EX.com", True), ("ex*", "exit", True), ("e*t", "exit", True), ("e.t", "exit", False), ("*", "", True), ("exit", "Exit", True), ("a**b", "ab", True)])
def test_glob(spark, pattern, text, hit):
    assert one(spark, net.glob(F.lit(text), pattern))[0] is hit


def test_published_vectors(spark):
    ip = lambda s: net.ip4_number(F.lit(s))
    r = one(spark, net.rss_hash(ip("66.9.149.187"), ip("161.142.100.80"), F.lit(2794), F.lit(1766)), net.rss_hash(ip("66.9.149.187"), ip("161.142.100.80")), net.community_id(F.lit(6), ip("128.232.110.120"), F.lit(34855), ip("66.35.250.204"), F.lit(80)))
    assert list(r) == [0x51CCC178, 0x323E8FC2, "1:LQU9qZlK+B5F3KDmev6m5PMibrg="]


def test_entropy_and_file_type(spark):
    r = one(spark, net.entropy(F.lit("")), net.entropy(F.lit("aaaa")), net.entropy(F.lit("abab")), net.file_type(F.lit(bytearray(b"MZ\x90"))))
    assert list(r) == [0.0, 0.0, 1.0, "exe"]


def test_filters_are_two_valued(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([6, 17, None]), rng.choice([10 << 24, None, (10 << 24) + 5]), rng.choice([1, None]), rng.choice([80, 53, None]), rng.choice([443, None])) for i in range(60)]
    df = spark.createDataFrame(rows, "seq long, proto long, src_ip4 long, dst_ip4 long, src_port long, dst_port long")
    atoms = [(filters.tcp, lambda r: r[1] == 6), (filters.port(53), lambda r: 53 in r[4:6]), (filters.network("10.0.0.0/30", "src"), lambda r: r[2] == 10 << 24), (filters.ports([80, 443], "dst"), lambda r: r[5] == 443)]
    for _ in range(6):
        (p, f), (q, g) = rng.sample(atoms, 2)
        for combined, want in ((p & q, lambda r: f(r) and g(r)), (p | q, lambda r: f(r) or g(r)), (~p, lambda r: not f(r)), (~(p & ~q), lambda r: not (f(r) and not g(r)))):
            assert {r.seq for r in filters.select(df, combined).collect()} == {r[0] for r in rows if want(r)}
    assert (filters.tcp & filters.port(443, "dst")).text == "tcp and dst port 443"
    assert filters.ANY & filters.tcp is filters.tcp and filters.ANY | filters.tcp is filters.ANY
    with pytest.raises(ValueError):
        filters.all_of(filters.tcp, filters.udp)
    with pytest.raises(ValueError):
        filters.ports([])


def test_three_datagrams_are_one_flow(spark):
    df = spark.createDataFrame([(i, (100 + i) * US, 17, 1, 54321, 2, 80, 32) for i in range(3)], PACKET)
    f = flows.flows(df).collect()
    assert len(f) == 1 and f[0].packets_initiator == 3 and f[0].bytes_initiator == 96 and f[0].reason == "idle" and f[0].b_port == 80


def test_flags_end_flows(spark):
    rows = [(0, 0, 6, 1, 10, 2, 80, 1, 2), (1, 1, 6, 2, 80, 1, 10, 1, 18), (2, 2, 6, 1, 10, 2, 80, 1, 4), (3, 3, 6, 1, 10, 2, 80, 1, 2)]
    df = spark.createDataFrame(rows, PACKET + ", tcp_flags int")
    got = {(r.start_us, r.packets_initiator, r.packets_responder, r.reason) for r in flows.flows(df).collect()}
    assert got == {(0, 2, 1, "rst"), (3, 1, 0, "idle")}
    assert flows.history(df, ["proto"]).first().history == "ShRS"


def test_flows_agree_with_single_packets_in_order(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(0, 4000) * US, 17, *((1, 5, 2, 6) if rng.random() < 0.5 else (2, 6, 1, 5)), 10) for i in range(120)]
    got = sorted((r.start_us, r.end_us, r.packets_initiator + r.packets_responder) for r in flows.flows(spark.createDataFrame(rows, PACKET)).collect())
    want, times = [], sorted(r[1] for r in rows)
    for t in times:
        if want and t - want[-1][1] <= 60 * US:
            want[-1] = (want[-1][0], t, want[-1][2] + 1)
        else:
            want.append((t, t, 1))
    assert got == want


def test_fragments_and_streams(spark):
    rows = [(1, 2, 17, 7, 0, 8, False, b"cd"), (1, 2, 17, 7, 0, 0, True, b"12345678"), (1, 2, 17, 8, 0, 16, False, b"x"), (1, 2, 17, 8, 0, 0, True, b"12345678")]
    got = flows.whole_datagrams(spark.createDataFrame(rows, "src_ip4 long, dst_ip4 long, proto long, ident long, ts_us long, offset long, more boolean, payload binary")).collect()
    assert [bytes(r.payload) for r in got] == [b"12345678cd"]
    parts = spark.createDataFrame([("f", 0, 0, b"abcd"), ("f", 1, 2, b"cdEF"), ("f", 2, 9, b"zz"), ("f", 3, 0, b"ab")], "flow string, seq long, offset long, payload binary")
    assert [(bytes(r.fresh), r.gap) for r in flows.ordered_payload(parts, ["flow"]).orderBy("offset").collect()] == [(b"abcd", 0), (b"EF", 0), (b"zz", 3)]


def _anomalies(spark, rows):
    df = spark.createDataFrame(rows, "kind string, severity string, ts_us long, key string")
    return df.withColumn("sev_rank", detect.severity_rank(F.col("severity"))).withColumn("observations", F.create_map().cast("map<string,string>")).withColumn("metrics", F.create_map().cast("map<string,double>"))


def test_layers(spark):
    a = _anomalies(spark, [(k, s, t, "x") for k in ("a", "b") for t, s in enumerate(("info", "warning", "error", "critical", "warning"))])
    assert {r.severity for r in layers.through(a, layers.min_severity("warning")).collect()} == {"warning", "error", "critical"}
    assert layers.through(a, layers.dedupe(US)).count() == 2
    assert layers.through(a, layers.rate_limit(3, US)).count() == 6
    assert layers.through(a, layers.sample(0.0)).count() == 0 and layers.through(a, layers.sample(1.0)).count() == 10
    seen = []
    assert layers.through(a, layers.tee(lambda d: seen.append(d.count())), layers.min_severity("error")).count() == 4 and seen == [10]


def test_folds_on_edges(spark):
    s = spark.createDataFrame([(0, t, x) for t, x in enumerate((0.0, 0.06, 0.04, 0.005, 0.02, 0.001, 0.001, 0.001, 0.2))], "source_idx long, ts_us long, drop_rate double")
    assert [(r.ts_us, r.edge) for r in detect.overload(s).orderBy("ts_us").collect()] == [(1, "enter"), (7, "leave"), (8, "enter")]
    assert folds.ewma(s.limit(0), ["source_idx"], ["ts_us"], "drop_rate", 0.5).count() == 0
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, ts_us long")
    assert folds.first_in_window(nulls, ["k"], ["ts_us"], "ts_us", 10).count() == 2


def test_lookup_limits(spark):
    rows = spark.createDataFrame([("k", 10), ("k", 15), ("k", 16), ("j", 10)], "k string, ts_us long")
    updates = spark.createDataFrame([("k", 5, 1), ("k", 10, 2), ("k", 10, 3)], "k string, ts_us long, v long")
    assert [(r.k, r.ts_us, r.v) for r in correlate.latest(rows, updates, ["k"], "v", 5).orderBy("k", "ts_us").collect()] == [("j", 10, None), ("k", 10, 3), ("k", 15, 3), ("k", 16, None)]


def test_indicators(spark):
    rows = spark.createDataFrame([(1, "login.EVIL.example."), (2, "notevil.example"), (3, None)], "id long, q string")
    bad = spark.createDataFrame([("evil.example", 9)], "domain string, reputation long")
    assert [(r.id, r.domain) for r in correlate.indicator_hosts(rows, "q", bad).collect()] == [(1, "evil.example")]


def test_rules(spark):
    rows = spark.createDataFrame([(1, "good.example"), (2, "login.evil.example"), (3, None)], "id long, dns_qname string")
    rule = {"title": "evil", "logsource": {"category": "dns"}, "detection": {"sel": {"query|contains": "evil"}, "condition": "sel"}}
    assert [tuple(r) for r in detect.rule_matches(rows, [rule], "id").collect()] == [(2, "evil", "medium")]
    with pytest.raises(ValueError):
        detect.rule_condition(rule | {"logsource": {"category": "other"}}, "x")
    with pytest.raises(ValueError):
        detect.rule_condition(rule | {"detection": rule["detection"] | {"condition": "sel and nothing"}}, "x")


def test_findings_as_json(spark):
    f = detect.finding(spark.createDataFrame([(1_500_000, "k")], "ts_us long, k string"), "scan", "error", "k", {"b": F.lit('"'), "a": F.lit("1")}, {"x": F.lit(float("nan")), "y": F.lit(2.0)})
    line = json.loads(f.select(formats.json_line(f)).first()[0])
    assert line["ts_secs"] == 1 and line["ts_nanos"] == 500_000_000 and line["observations"] == {"a": "1", "b": '"'} and line["metrics"].get("x") is None and line["metrics"]["y"] == 2.0
    assert json.loads(f.select(formats.finding_record(f)).first()[0])["severity_id"] == 4
    assert detect.tagged(detect.finding(spark.createDataFrame([(1, "k")], "ts_us long, k string"), "port_scan", "error", "k")).first().observations == {"attack_technique": "T1046"}


def _frame(src: int, dst: int, sport: int, dport: int, payload: bytes) -> bytes:
    udp = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    return b"\xaa" * 6 + b"\xbb" * 6 + b"\x08\x00" + struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(udp), 1, 0, 64, 17, 0, src, dst) + udp


def test_capture_files(spark, tmp_path):
    query = struct.pack(">HHHHHH", 77, 0x0100, 1, 0, 0, 0) + b"\x05login\x04evil\x07example\x00\x00\x01\x00\x01"
    packets = spark.createDataFrame([((100 + i) * 10**9 + 5, 60, bytearray(_frame(10, 20, 5000, 53, query))) for i in range(3)], "ts_ns long, len long, data binary")
    for i, r in enumerate(capture.file_bytes(packets.coalesce(1), per_file=2).collect()):
        (tmp_path / f"{i}.pcap").write_bytes(bytes(r.content))
    got = capture.read(spark, f"file://{tmp_path}")
    assert [(r.ts_ns, r.src_ip, r.dst_port, r.proto) for r in got.orderBy("ts_ns").collect()] == [((100 + i) * 10**9 + 5, "0.0.0.10", 53, 17) for i in range(3)]
    d = capture.dns(got).first()
    assert (d.dns_id, d.dns_response, d.dns_qname) == (77, False, "login.evil.example")
    assert flows.flows(got.withColumn("tcp_flags", F.coalesce("tcp_flags", F.lit(0)))).first().packets_initiator == 3


def test_capture_next_generation():
    body = struct.pack("<IIIII", 0, 0, 7_000_000, 4, 4) + b"abcd"
    block = lambda kind, b: struct.pack("<II", kind, 12 + len(b)) + b + struct.pack("<I", 12 + len(b))
    data = block(0x0A0D0D0A, b"\x4d\x3c\x2b\x1a" + struct.pack("<HHq", 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0)) + block(6, body)
    assert list(capture.frames(data)) == [(7_000_000_000, 4, b"abcd")] and list(capture.frames(b"")) == []
    assert capture.decode(b"short") == {}


def test_http_and_arp(spark):
    arp = struct.pack(">HHBBH", 1, 0x0800, 6, 4, 2) + bytes([0xAA] * 6) + bytes([192, 0, 2, 50]) + bytes([0xBB] * 6) + bytes([192, 0, 2, 9])
    rows = spark.createDataFrame([(1, 1, 2054, bytearray(arp)), (2, 2, 2048, bytearray(b"GET /a HTTP/1.1\r\nHost: X.org\r\n\r\n"))], "seq long, ts_us long, ethertype long, payload binary")
    a, h = capture.arp(rows).first(), capture.http(rows).first()
    assert (a.oper, a.ip, a.mac, a.target_ip) == ("reply", "192.0.2.50", "aa:aa:aa:aa:aa:aa", "192.0.2.9") and (h.http_method, h.http_path, h.http_host) == ("GET", "/a", "x.org")


def test_reports_of_an_empty_table(spark):
    p = spark.createDataFrame([], PACKET)
    for df in (reports.talkers(p, US, 3), reports.rolling(p, ["src_ip4"], "len", 10, 1), flows.flows(p), detect.walk(p, "src_ip4", F.lit(True)), detect.port_scan(p, 1, US), reports.rolling_distinct(p, ["src_ip4"], "dst_ip4", 10, 1)):
        assert df.count() == 0


def test_every_query_has_its_twin():
    assert set(queries.queries()) == set(queries.oracle_sql())


@pytest.mark.parametrize("window", [1, 3, 10, 10**12])
def test_rolling_distinct_over_any_window(spark, window):
    """Long windows copy nothing: no row goes to each bucket of its window. Null is no value."""
    rng = random.Random(window)
    rows = [(rng.randrange(3), rng.choice([None, 1, 2, 3, 4]), rng.randrange(60)) for _ in range(150)] + [(7, None, 5), (None, 1, 5)]
    got = reports.rolling_distinct(spark.createDataFrame(rows, "k int, v int, ts_us long").repartition(3), ["k"], "v", 2 * window, 2)
    want = {(k, t // 2): len({v for k2, v, t2 in rows if k2 == k and t // 2 - window < t2 // 2 <= t // 2 and v is not None}) for k, _, t in rows if k is not None}
    assert {(r.k, r.bucket): r.n_distinct for r in got.collect()} == want
