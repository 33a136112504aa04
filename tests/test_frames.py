"""Frames told all at once against a walk over each one's bytes."""

import ipaddress
import random
import struct

import pyarrow as pa

from tidewire.sources import capture


def walk(frame):
    """Header fields of a frame, one after the other; what is not there is left out."""
    if frame is None or len(frame) < 14:
        return {}
    out = {"dst_mac6": frame[:6], "src_mac6": frame[6:12]}
    kind, at = struct.unpack_from(">H", frame, 12)[0], 14
    while kind in (0x8100, 0x88A8) and len(frame) >= at + 4:
        tag, kind = struct.unpack_from(">HH", frame, at)
        out.setdefault("vlan_id", tag & 0x0FFF)
        at += 4
    out["ethertype"], first = kind, True
    if kind == 0x0800 and len(frame) >= at + 20:
        head, total, out["ident"], place = frame[at], *struct.unpack_from(">HHH", frame, at + 2)
        out["frag_offset"], out["more_fragments"] = (place & 0x1FFF) * 8, bool(place & 0x2000)
        first, out["proto"] = not place & 0x1FFF, frame[at + 9]
        out["src_ip4"], out["dst_ip4"] = struct.unpack_from(">II", frame, at + 12)
        frame, at = frame[: at + total] if total else frame, at + (head & 15) * 4
    elif kind == 0x86DD and len(frame) >= at + 40:
        out["proto"], out["src_ip6"], out["dst_ip6"] = frame[at + 6], frame[at + 8 : at + 24], frame[at + 24 : at + 40]
        size = struct.unpack_from(">H", frame, at + 4)[0]
        frame, at = frame[: at + 40 + size] if size else frame, at + 40
        while out["proto"] in capture.OPTIONS and len(frame) >= at + 8:
            out["proto"], at = frame[at], at + 8 + 8 * frame[at + 1]
    else:
        return out | {"payload": frame[at:]}
    if first and out["proto"] in (6, 17) and len(frame) >= at + 8:
        out["src_port"], out["dst_port"] = struct.unpack_from(">HH", frame, at)
        if out["proto"] == 17:
            at += 8
        elif len(frame) >= at + 20:
            out["tcp_seq"], out["tcp_flags"] = struct.unpack_from(">I", frame, at + 4)[0], frame[at + 13]
            at += (frame[at + 12] >> 4) * 4
    return out | {"payload": frame[at:]}


def made(rng):
    """A frame of any shape: tags, families, options, fragments, wrong lengths, padding, cut anywhere."""
    body = rng.randbytes(rng.randrange(30))
    proto = rng.choice([6, 17, 1, 58, 47])
    inner = rng.randbytes(4) + (rng.randbytes(8) + bytes([rng.choice([0x50, 0x80, 0xF0, 0x20])]) + rng.randbytes(7) if proto == 6 else rng.randbytes(4)) + body
    if rng.random() < 0.5:
        size = 20 + len(inner) + rng.choice([0, 0, 0, -3, 50])
        packet = struct.pack(">BBHHHBB", rng.choice([0x45, 0x45, 0x47, 0x40]), 0, rng.choice([size, 0]), rng.randrange(65536), rng.choice([0, 0, 0x2000, 0x00FF]), 64, proto) + rng.randbytes(10) + inner
        kind = 0x0800
    else:
        options = rng.choice([[], [], [0], [60, 43], [0, 43, 60]])
        chain = b"".join(bytes([(options[1:] + [proto])[i], rng.choice([0, 0, 1])]) + rng.randbytes(6) for i in range(len(options)))
        packet = struct.pack(">IHBB", 6 << 28, rng.choice([len(chain + inner), 0, 4]), (options + [proto])[0], 64) + rng.randbytes(32) + chain + inner
        kind = 0x86DD
    kind = rng.choice([kind] * 9 + [0x0806])
    tags = b"".join(struct.pack(">HH", rng.choice([0x8100, 0x88A8]), rng.randrange(65536)) for _ in range(rng.choice([0, 0, 0, 1, 2, 3])))
    frame = rng.randbytes(12) + tags + struct.pack(">H", kind) + packet + bytes(rng.choice([0, 0, 6]))
    return frame[: rng.randrange(len(frame) + 1)] if rng.random() < 0.3 else frame


def test_as_by_walking():
    rng = random.Random(4)
    frames = [made(rng) for _ in range(3000)] + [None, b"", b"x" * 13]
    n = len(frames)
    batch = capture.table(pa.array(["f"] * n), pa.array(range(n)), pa.array([5] * n), None, pa.array([b"before", *frames, b"after"], pa.binary()).slice(1, n))
    fields = [f for f in batch.schema.names if f not in ("source", "seq", "ts_ns", "cap_len", "len")]
    for row, frame in zip(batch.to_pylist(), frames, strict=True):
        want = walk(frame)
        assert {f: row[f] for f in fields} == {f: want.get(f) for f in fields}, frame
        assert row["len"] == row["cap_len"] == len(frame or b"")


def test_text_of_addresses(spark):
    rng = random.Random(5)
    frames = [f for f in (made(rng) for _ in range(200)) if f]
    rows = spark.createDataFrame([("f", i, 1_000_001_999, f) for i, f in enumerate(frames)], "source string, seq long, ts_ns long, data binary")
    got = capture.decoded(rows).orderBy("seq").collect()
    assert got[0].ts_us == 1_000_001 and capture.decoded(rows).columns == capture.COLUMNS
    for r, frame in zip(got, frames, strict=True):
        want = walk(frame)
        ip = want.get("src_ip4", want.get("src_ip6"))
        assert (None if r.src_ip is None else ipaddress.ip_address(r.src_ip)) == (None if ip is None else ipaddress.ip_address(ip))
        assert r.src_mac == (want["src_mac6"].hex(":") if want else None)
