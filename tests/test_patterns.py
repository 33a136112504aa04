"""Patterns with gaps and signatures across segments, against brute force."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.test_streams import sent, table
from tidewire.operators import correlate, patterns

EICAR = rb"X5O!P%@AP[4\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"


def brute(events, pattern, window, unless=None, strict=(), many=()):
    """(seq, began) of every event that ends a match: the begin is that of the latest-begun match, over all choices of events."""
    out = []
    for key in {e[0] for e in events}:
        own = sorted((t, n, c) for k, n, t, c in events if k == key)
        for end, (t, n, c) in enumerate(own):
            best = None
            most = len(pattern) + (2 if many else 0)
            for size in range(len(pattern), most + 1):
                for some in combinations(range(end), size - 1):
                    chosen = [*some, end]
                    for labels in _spread(len(chosen), len(pattern), many):
                        if any(own[i][2] != pattern[s] for i, s in zip(chosen, labels, strict=True)):
                            continue
                        fine = t - own[chosen[0]][0] <= window
                        for (i, a), (j, b) in zip(zip(chosen, labels), list(zip(chosen, labels))[1:]):
                            if a != b and b in strict and j != i + 1:
                                fine = False
                            if a != b and unless and b in unless and any(own[x][2] == unless[b] for x in range(i, j)[1:]):
                                fine = False
                        if fine:
                            began = own[chosen[0]][0]
                            best = began if best is None else max(best, began)
            if best is not None:
                out.append((key, n, best))
    return sorted(out)


def _spread(events, steps, many):
    """Which step each chosen event stands for: steps in order, those of ``many`` more than once."""
    if not many:
        return [list(range(steps))] if events == steps else []
    out = []

    def go(labels):
        if len(labels) == events:
            if labels[-1] == steps - 1:
                out.append(labels)
            return
        last = labels[-1] if labels else -1
        if labels and last in many:
            go([*labels, last])
        if last + 1 < steps:
            go([*labels, last + 1])

    go([])
    return out


CASES = {
    "gaps": ("abc", {}),
    "one letter twice": ("aab", {}),
    "broken wait": ("abc", {"unless": {2: "x"}}),
    "next one only": ("abc", {"strict": (1,)}),
    "one or more": ("abc", {"many": (1,)}),
}


@pytest.mark.parametrize("name", CASES)
def test_patterns(spark, name):
    pattern, how = CASES[name]
    rng = random.Random(name)
    events = [(rng.randrange(3), i, rng.randrange(60), rng.choice("abcx")) for i in range(36)]
    rows = spark.createDataFrame(events, "k long, seq long, ts_us long, c string").repartition(3)
    letter = lambda x: F.col("c") == x
    steps = [patterns.Step(letter(x), letter(how["unless"][i]) if i in how.get("unless", {}) else None, i in how.get("strict", ()), i in how.get("many", ())) for i, x in enumerate(pattern)]
    for window in (5, 20, 1000):
        got = sorted((r.k, r.seq, r.began_us) for r in patterns.matches(rows, ["k"], steps, window).collect())
        assert got == brute(events, pattern, window, how.get("unless"), how.get("strict", ()), how.get("many", ())), window


def test_once_and_null_keys(spark):
    rows = spark.createDataFrame([(None, i, t, c) for i, (t, c) in enumerate([(0, "a"), (1, "b"), (2, "b"), (3, "a"), (None, "a"), (4, "b")])], "k long, seq long, ts_us long, c string")
    steps = [patterns.Step(F.col("c") == "a"), patterns.Step(F.col("c") == "b")]
    told = lambda once: [(r.seq, r.began_us) for r in patterns.matches(rows, ["k"], steps, 10, once).orderBy("seq").collect()]
    assert told(False) == [(1, 0), (2, 0), (5, 3)]
    assert told(True) == [(1, 0), (5, 3)]


def test_signature_over_two_segments(spark):
    rules = [patterns.Signature("eicar", {"a": b"EICAR-STANDARD-ANTIVIRUS-TEST-FILE"}, "n_a > 0"), patterns.Signature("none", {"a": b"nothing"}, "n_a > 0")]
    for size in (1, 20, 1000):
        got = patterns.signatures(table(spark, sent(EICAR, 9, size=size)), rules).collect()
        assert [(r.rule, r.src_port, r.size) for r in got] == [("eicar", 4000, len(EICAR))]
    assert patterns.signatures(table(spark, sent(b"GET / HTTP/1.1\r\nHost: example\r\n\r\n", 9)), rules).collect() == []


def test_counts_and_places(spark):
    rng = random.Random(8)
    strings = [(b"ab", False), (b"aba", False), (b"AB", True), (b"b", False)]
    bodies = [bytes(rng.choice(b"abAB") for _ in range(rng.randrange(1, 60))) for _ in range(5)]
    p = table(spark, *(sent(b, rng.randrange(1 << 32), size=rng.randrange(1, 9), ends=(1, 100 + i, 2, 80), shuffle=i) for i, b in enumerate(bodies)))
    for r in patterns.counted(p, strings).collect():
        body = bodies[r.src_port - 100]
        for i, (s, nocase) in enumerate(strings):
            data, s = (body.lower(), s.lower()) if nocase else (body, s)
            at = [k for k in range(len(data)) if data.startswith(s, k)]
            assert (r.n[i], r.first[i], r.last[i]) == (len(at), min(at, default=None), max(at, default=None)), (body, s)


def test_gap_and_datagrams(spark):
    rows = [r for i, r in enumerate(sent(b"x" * 10 + b"hello" + b"world!" * 3, 9, size=5)) if i != 4]  # the SYN is the first
    rules = [patterns.Signature("w", {"w": b"hellow"}, "n_w > 0"), patterns.Signature("o", {"o": b"rld!wo"}, "n_o > 0 AND first_o > 15")]
    assert [r.rule for r in patterns.signatures(table(spark, rows), rules).collect()] == ["o"]
    udp = table(spark, sent(b"hello" * 2 + b"hellow", 9, size=3)).withColumn("proto", F.lit(17))
    assert [r.rule for r in patterns.signatures(udp, rules).collect()] == ["w"]


def test_open_ended_periods(spark):
    far = (1 << 63) - 1
    rows = spark.createDataFrame([(k, t) for k in (1, 2) for t in (-5, 0, 10, 20, 400 * 86_400_000_000)], "k long, ts_us long")
    periods = spark.createDataFrame([(1, 0, far, "open"), (1, 10, 15, "in"), (1, 30, 1 << 62, "long"), (2, 5, None, "null"), (2, 8, 7, "never")], "k long, a long, b long, name string")
    got = {(r.k, r.ts_us): r.name for r in correlate.within(rows, periods, ["k"], "a", "b", ["name"]).collect()}
    day = 400 * 86_400_000_000
    assert got == {(1, -5): None, (1, 0): "open", (1, 10): "in", (1, 20): "open", (1, day): "long", (2, -5): None, (2, 0): None, (2, 10): "null", (2, 20): "null", (2, day): "null"}
