"""Capture files by splits, piece by piece, and as a growing stream: the same packets as read whole."""

import random
import struct

import pytest

from tidewire.sources import capture, pcap_source


def frame(rng, n):
    body = rng.randbytes(rng.randrange(0, 700)) + struct.pack("<IIII", 100, 5, 60, 60) * rng.randrange(3)  # headers that are none
    udp = struct.pack(">HHHH", n % 65536, 53, 8 + len(body), 0) + body
    ip = struct.pack(">BBHHHBBHII", 0x45, 0, 20 + len(udp), n % 65536, 0, 64, 17, 0, 1, 2) + udp
    return bytes(12) + b"\x08\x00" + ip


def pcap(frames, order="<", nano=True):
    head = struct.pack(order + "IHHiIII", 0xA1B23C4D if nano else 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    return head, [struct.pack(order + "IIII", 100 + i // 7, i % 1000, len(f), len(f)) + f for i, f in enumerate(frames)]


def pcapng(frames):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0))
    for i, f in enumerate(frames):
        out += block(6, struct.pack("<IIIII", 0, 0, 100 + i, len(f), len(f)) + f + b"\0" * (-len(f) % 4))
    return out


def told(df):
    return sorted((r.ts_ns, r.src_port, r.len, bytes(r.payload)) for r in df.select("ts_ns", "src_port", "len", "payload").collect())


@pytest.mark.parametrize("order", ["<", ">"])
def test_splits_give_what_whole_files_give(spark, tmp_path, order):
    rng = random.Random(1)
    head, packets = pcap([frame(rng, n) for n in range(900)], order, order == "<")
    (tmp_path / "a.pcap").write_bytes(head + b"".join(packets))
    (tmp_path / "b.pcap").write_bytes(head + b"".join(packets[:5]) + packets[5][:-3])  # cut off
    (tmp_path / "empty.pcap").write_bytes(head)
    want = told(capture.read(spark, str(tmp_path)))
    assert len(want) == 905
    for split in (0, 10_000, 77_777):
        df = pcap_source.scan(spark, str(tmp_path), split)
        assert told(df) == want, split
    assert pcap_source.scan(spark, f"file://{tmp_path}", 10_000).rdd.getNumPartitions() > 20


def test_pcapng_block_by_block(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "c.pcapng").write_bytes(pcapng([frame(rng, n) for n in range(300)]))
    assert told(pcap_source.scan(spark, str(tmp_path), 5000)) == told(capture.read(spark, str(tmp_path)))


def test_no_capture_file(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"hello world, no capture at all")
    with pytest.raises(Exception, match="no capture file"):
        pcap_source.scan(spark, str(tmp_path)).collect()


def test_growing_file(spark, tmp_path):
    rng = random.Random(3)
    head, packets = pcap([frame(rng, n) for n in range(400)])
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    file = folder / "g.pcap"
    whole = head + b"".join(packets)
    for cut in (30, 40_000, 40_001, len(whole) - 5, len(whole)):
        file.write_bytes(whole[:cut])
        stream = pcap_source.follow(spark, str(folder), 10_000).select("ts_ns", "src_port", "len", "payload")
        q = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination(60)
        assert q.exception() is None
    got = told(spark.read.parquet(str(out)))
    assert got == told(capture.read(spark, str(folder))) and len(got) == 400
