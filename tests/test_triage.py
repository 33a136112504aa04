from tidewire.operators import triage

FLOW = "a_ip4 long, b_ip4 long, b_port long, start_us long, end_us long, a_initiated boolean, bytes_initiator long, bytes_responder long, reason string"


def test_lateral_movement_takes_what_columns_there_are(spark):
    rows = spark.createDataFrame([(1, 9, "ADMIN$", None), (2, 9, None, "drsuapi"), (3, 9, "docs", None), (4, 9, None, None)], "ts_us long, src_ip4 long, smb_share string, smb_pipe string")
    got = triage.lateral_movement(rows).collect()
    assert {(r.ts_us, r.kind, r.severity, r.sev_rank, r.key) for r in got} == {(1, "smb_admin_share", "warning", 1, "9"), (2, "directory_replication", "critical", 3, "9")}
    assert all(r.observations == {} for r in got)
    assert triage.lateral_movement(rows.drop("smb_share", "smb_pipe")).count() == 0


def test_flows(spark):
    f = spark.createDataFrame([(1, 2, 80, 0, 5, True, 0, 0, "rst"), (1, 2, 80, 6, 9, True, 50, 9, "rst"), (1, 2, 443, 10, 19, False, 900, 1, "idle")], FLOW)
    assert {(r.ts_us, r.severity) for r in triage.resets(f).collect()} == {(5, "warning"), (9, "info")}
    assert [(r.ts_us, r.key, r.metrics["bytes"]) for r in triage.exfiltration(f, 100).collect()] == [(19, "2", 900.0)]
    m = spark.createDataFrame([(1, 3, "x"), (1, 4, "a"), (1, 12, None), (7, 3, "q")], "a_ip4 long, ts_us long, sni string")
    assert {(r.start_us, r.sni, r.n_sni) for r in triage.summaries(f, m, ["a_ip4"], ["sni"]).collect()} == {(0, "a", 2), (6, None, None), (10, None, 0)}
    assert triage.union(triage.resets(f), triage.exfiltration(f, 100)).count() == 3


def test_messages(spark):
    e = spark.createDataFrame([(1, 5, "accepted", "a"), (2, 5, "rejected", "b"), (3, 5, "grease", "c"), (4, 5, None, None)], "ts_us long, src_ip4 long, ech string, sni string")
    assert {(r.ts_us, r.severity) for r in triage.hidden_names(e).collect()} == {(1, "info"), (2, "warning")}
    i = spark.createDataFrame([(1, 5, "net_unreachable"), (2, 5, "time_exceeded")], "ts_us long, src_ip4 long, icmp_kind string")
    assert {(r.ts_us, r.severity) for r in triage.icmp_errors(i).collect()} == {(1, "warning"), (2, "info")}
    p = spark.createDataFrame([(t, t, 5, 2 if t < 6 else 16) for t in range(10)], "seq long, ts_us long, src_ip4 long, tcp_flags int")
    assert [(r.key, r.metrics["count"], r.severity) for r in triage.floods(p, 5, 20, 10).collect()] == [("5", 6.0, "critical")]
