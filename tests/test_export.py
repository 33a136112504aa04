"""Export messages read back by a parser of their own, and header bits against plain loops."""

import random
import struct

import numpy as np
import pyarrow as pa

from tidewire.sources import bits, ipfix


def parse(message):
    """(sequence, templates, records) of a message by the standard alone."""
    version, size, export, sequence, domain = struct.unpack_from(">HHIII", message)
    assert version == 10 and size == len(message)
    at, templates, records = 16, {}, []
    while at < size:
        kind, n = struct.unpack_from(">HH", message, at)
        body, at = message[at + 4 : at + n], at + n
        if kind == 2:
            k = 0
            while k < len(body):
                number, fields = struct.unpack_from(">HH", body, k)
                templates[number] = [struct.unpack_from(">HH", body, k + 4 + 4 * i) for i in range(fields)]
                k += 4 + 4 * fields
        else:
            records.append((kind, body))
    return sequence, domain, export, templates, records


def read(messages):
    known, out, expected = {}, [], 0
    for m in messages:
        sequence, domain, export, templates, sets = parse(bytes(m))
        assert sequence == expected and domain == 7
        known |= templates
        for kind, body in sets:
            size = sum(n for _, n in known[kind])
            assert len(body) % size == 0
            for k in range(0, len(body), size):
                row, at = {}, k
                for e, n in known[kind]:
                    row[e] = int.from_bytes(body[at : at + n], "big")
                    at += n
                assert row[153] // 1000 == export
                out.append(row)
                expected += 1
    return out


def test_messages_are_read_back(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        six = rng.random() < 0.3
        end = rng.randrange(20) * 1_000_000 + rng.randrange(1_000_000)
        rows.append((rng.choice([6, 17, 1]), None if six else rng.randrange(1 << 32), rng.randrange(1 << 16) if i % 9 else None, None if six else rng.randrange(1 << 32), rng.randrange(1 << 16), rng.randbytes(16) if six else None, rng.randbytes(16) if six else None, end - 5000, end, rng.random() < 0.5, i, 2 * i, 100 * i, 300 * i, rng.choice(["fin", "rst", "idle", None])))
    rows += rows[:3]
    f = spark.createDataFrame(rows, "proto int, a_ip4 long, a_port int, b_ip4 long, b_port int, a_ip6 binary, b_ip6 binary, start_us long, end_us long, a_initiated boolean, packets_initiator long, packets_responder long, bytes_initiator long, bytes_responder long, reason string")
    for per, resend in ((16, 0), (1, 5), (3, 1)):
        got = ipfix.messages(f, 7, per, resend, 4).orderBy("number").collect()
        assert [r.number for r in got] == list(range(len(got))) and sum(r.n_records for r in got) == len(rows)
        back = read([r.message for r in got])
        want = []
        for proto, a4, ap, b4, bp, a6, b6, start, end, own, pi, pr, bi, br, reason in rows:
            a, b = (int.from_bytes(a6, "big"), int.from_bytes(b6, "big")) if a6 else (a4, b4)
            (a, ap), (b, bp) = ((a, ap or 0), (b, bp)) if own else ((b, bp), (a, ap or 0))
            code = {"fin": 3, "rst": 3, "idle": 1, None: 2}[reason]
            want.append({4: proto, 7: ap, 11: bp, **({27: a, 28: b} if a6 else {8: a, 12: b}), 1: bi, 2: pi, 85: bi + br, 86: pi + pr, 152: start // 1000, 153: end // 1000, 6: 0, 136: code})
        assert sorted(map(sorted, (r.items() for r in back))) == sorted(map(sorted, (r.items() for r in want)))
        with_templates = [bool(parse(bytes(r.message))[3]) for r in got]
        assert with_templates == [i == 0 if not resend else i % resend == 0 for i in range(len(got))]
    assert ipfix.messages(f.limit(0), 7).collect() == []


def slow(frame, payload):
    """The same, byte by byte."""
    out = {h: [-1] * 8 * n for h, n in bits.HEADERS.items()} | {"payload": [-1] * 8 * payload}

    def put(name, data):
        for i, byte in enumerate(data[: len(out[name]) // 8]):
            out[name][8 * i : 8 * i + 8] = [byte >> k & 1 for k in range(7, -1, -1)]

    at, kind = 14, int.from_bytes(frame[12:14], "big")
    for _ in range(2):
        if kind in (0x8100, 0x88A8):
            kind, at = int.from_bytes(frame[at + 2 : at + 4], "big"), at + 4
    rest, first = frame[at:], True
    if kind == 0x0800 and len(rest) >= 20:
        head, proto, first = (rest[0] & 15) * 4, rest[9], not int.from_bytes(rest[6:8], "big") & 0x1FFF
        put("ipv4", rest[:head])
    elif kind == 0x86DD and len(rest) >= 40:
        head, proto = 40, rest[6]
        put("ipv6", rest[:40])
    else:
        head, proto, first = 0, -1, False
    rest = rest[head:] if first else b""
    name, least = {6: ("tcp", 20), 17: ("udp", 8), 1: ("icmp", 8), 58: ("icmp", 8)}.get(proto, (None, 0))
    if name and len(rest) >= least:
        size = (rest[12] >> 4) * 4 if name == "tcp" else 8
        put(name, rest[:size])
        if payload:
            put("payload", rest[size : size + payload])
    return sum(out.values(), [])


def frames(rng):
    tcp = lambda options, body: struct.pack(">HHIIBBHHH", 1, 2, 3, 4, (5 + options) << 4, 24, 5, 6, 0) + bytes(4 * options) + body
    four = lambda proto, data, options=0, place=0: struct.pack(">BBHHHBBHII", 0x45 + options, 0, 20 + 4 * options + len(data), 7, place, 64, proto, 0, 1, 2) + rng.randbytes(4 * options) + data
    six = lambda proto, data: struct.pack(">IHBB", 6 << 28, len(data), proto, 64) + rng.randbytes(32) + data
    ether = lambda kind, data, tags=0: rng.randbytes(12) + b"\x81\x00\x00\x05" * tags + struct.pack(">H", kind) + data
    udp = struct.pack(">HHHH", 1, 53, 12, 0) + b"abcd"
    out = [ether(0x0800, four(6, tcp(3, b"hello"))), ether(0x0800, four(17, udp, 2), 1), ether(0x86DD, six(17, udp), 2), ether(0x86DD, six(58, b"\x80\0\0\0\0\1\0\2xy")), ether(0x0800, four(1, b"\x08\0\0\0\0\1\0\2")), ether(0x0806, bytes(28)), ether(0x0800, four(17, udp, 0, 5)), b"", b"short", None]
    return out + [f[:k] for f in out[:4] for k in (20, 33, 34, 36, 40, 55)]


def test_bits_as_by_hand():
    all_ = frames(random.Random(1))
    for payload in (0, 6):
        got = bits.matrix(pa.array(all_, pa.binary()), payload)
        assert got.shape == (len(all_), bits.width(payload))
        for row, f in zip(got, all_, strict=True):
            assert row.tolist() == slow(f or b"", payload)
        assert np.array_equal(bits.matrix(pa.array([b"x", *all_, b"y"], pa.binary()).slice(1, len(all_)), payload), got)


def test_matrices_of_flows(spark):
    all_ = [f for f in frames(random.Random(2)) if f]
    p = spark.createDataFrame([(i % 2, 100 - i, i, f) for i, f in enumerate(all_)], "k int, ts_us long, seq long, data binary")
    got = bits.flow_matrices(p, ["k"], 4, 3).orderBy("k", "nth").collect()
    assert [(r.k, r.nth) for r in got] == [(k, n) for k in (0, 1) for n in range(3)] and {len(r.bits) for r in got} == {bits.width(4)}
    last = max(i for i in range(len(all_)) if i % 2 == 0)
    assert list(got[0].bits) == slow(all_[last], 4)
