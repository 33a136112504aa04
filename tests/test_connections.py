"""States of TCP connections: one flow for an ordinary close, and what begins a new one."""

import re

import pytest
from pyspark.sql import functions as F

from tidewire.operators import flows

S, SA, A, FA, R, P = 2, 18, 16, 17, 4, 24
SCHEMA = "seq long, ts_us long, proto int, src_ip4 long, src_port int, dst_ip4 long, dst_port int, tcp_flags int, tcp_seq long, len long"
SEC = 1_000_000


def build(spark, steps, more=None):
    """steps: (seconds, 'c' or 's', flags, bytes[, tcp_seq])."""
    rows = []
    for i, (t, side, flags, size, *isn) in enumerate(steps):
        ends = (1, 5000, 2, 443) if side == "c" else (2, 443, 1, 5000)
        rows.append((i, int(t * SEC), 6, *ends, flags, isn[0] if isn else 0, size))
    return spark.createDataFrame(rows, SCHEMA)


def told(f, *columns):
    return [tuple(r[c] for c in columns) for r in f.orderBy("start_us").collect()]


ORDINARY = [(0, "c", S, 0), (0.1, "s", SA, 0), (0.2, "c", A, 0), (0.3, "c", FA, 300), (0.4, "s", A, 0), (0.5, "s", P, 2500), (0.6, "s", P, 2500), (0.65, "c", A, 0), (0.7, "s", FA, 0), (0.8, "c", A, 0)]


def test_ordinary_close_is_one_flow(spark):
    f = flows.flows(build(spark, ORDINARY))
    got = told(f, "packets_initiator", "packets_responder", "bytes_initiator", "bytes_responder", "a_initiated", "reason", "state", "established_us")
    assert got == [(5, 5, 300, 5000, True, "fin", "closed", 200_000)]
    events = {r.event: r.ts_us for r in flows.lifecycle(f).collect()}
    assert events == {"started": 0, "established": 200_000, "ended": 800_000}


CASES = {
    "half close goes on": (ORDINARY[:7], [("half_closed", "idle", 7)]),
    "simultaneous close": ([*ORDINARY[:3], (1, "c", FA, 0), (1, "s", FA, 0), (1.1, "c", A, 0), (1.1, "s", A, 0)], [("closed", "fin", 7)]),
    "late packets of a closed one": ([*ORDINARY, (5, "s", FA, 0), (6, "c", R, 0)], [("reset", "rst", 12)]),
    "simultaneous open": ([(0, "c", S, 0, 1), (0, "s", S, 0, 7), (0.1, "c", SA, 0, 1), (0.1, "s", SA, 0, 7), (0.2, "c", A, 0)], [("established", "idle", 5)]),
    "syn sent again": ([(0, "c", S, 0, 9), (1, "c", S, 0, 9), (1.1, "s", SA, 0, 3), (1.2, "c", A, 0)], [("established", "idle", 4)]),
    "syn of another number": ([(0, "c", S, 0, 9), (1, "c", S, 0, 10)], [("opening", "idle", 1), ("opening", "idle", 1)]),
    "reused ends": ([*ORDINARY, (2, "c", S, 0, 99), (2.1, "s", SA, 0, 98), (2.2, "c", A, 0), (2.3, "c", R, 0)], [("closed", "fin", 10), ("reset", "rst", 4)]),
    "refused": ([(0, "c", S, 0), (0.1, "s", R | A, 0)], [("reset", "rst", 2)]),
    "strays after the wait": ([*ORDINARY, (90, "s", A, 0), (91, "s", A, 0)], [("closed", "fin", 10), ("midstream", "idle", 2)]),
    "seen from the middle": ([(0, "s", P, 10), (1, "c", A, 0)], [("midstream", "idle", 2)]),
    "silence": ([(0, "c", P, 1), (1000, "c", P, 1)], [("midstream", "idle", 1), ("midstream", "idle", 1)]),
    "one way only": ([(0, "c", S, 0), (1, "c", A, 5), (2, "c", FA, 0)], [("closed", "fin", 3)]),
}


@pytest.mark.parametrize("name", CASES)
def test_states(spark, name):
    steps, want = CASES[name]
    p = build(spark, steps)
    f = flows.flows(p)
    got = told(f.withColumn("n", F.col("packets_initiator") + F.col("packets_responder")), "state", "reason", "n")
    assert got == want
    spans = {(r.start_us, r.end_us) for r in flows.tracked(p).select("start_us", "end_us").collect()}
    assert spans == {(r.start_us, r.end_us) for r in f.collect()}


def test_initiator(spark):
    """Who sent the SYN, or whom a SYN with ACK answers, whatever came first."""
    late = build(spark, [(0, "s", SA, 0), (0.1, "c", A, 10)])
    assert told(flows.flows(late), "a_initiated", "packets_initiator") == [(True, 1)]


def test_datagrams_have_no_state(spark):
    p = build(spark, [(0, "c", 0, 5), (1, "s", 0, 6)]).withColumns({"proto": F.lit(17), "tcp_flags": F.lit(None).cast("int")})
    assert told(flows.flows(p), "state", "reason", "bytes_responder", "established_us") == [(None, "idle", 6, None)]


def test_history_of_ip6(spark):
    rows = [(0, 0, 2, b"\x01" * 16, 1), (1, 1, 18, b"\x02" * 16, 2), (2, 2, 24, b"\x01" * 16, 1), (3, 3, 24, b"\x01" * 16, 2)]
    p = spark.createDataFrame([(n, t, f, None, a, port, 5, "k") for n, t, f, a, port in rows], "seq long, ts_us long, tcp_flags int, src_ip4 long, src_ip6 binary, src_port int, len long, k string")
    assert flows.history(p, ["k"]).first().history == "ShDD"
    assert flows.history(p.withColumn("a_port", F.lit(1)), ["k", "a_port"]).first().history == "ShDd"


def test_states_take_one_order_of_a_key(spark):
    """What a task sorts at once bounds its memory: packets and runs in order of time, and both for their sums; nothing is sorted once more for each state."""
    plan = flows.flows(build(spark, ORDINARY))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bSort \[", plan)) <= 5
