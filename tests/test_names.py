import struct

from tidewire.sources import capture


def test_names_of_many_labels(spark):
    names = [".".join([f"{i % 16:x}" for i in range(32)] + ["ip6", "arpa"]), ".".join("x" * 127), "a.example", ""]
    wire = lambda n: b"".join(bytes([len(x)]) + x.encode() for x in n.split(".") if x) + b"\x00"
    rows = [(17, 5000, 53, bytearray(struct.pack(">HHHHHH", i, 0x0100, 1, 0, 0, 0) + wire(n) + b"\x00\x0c\x00\x01")) for i, n in enumerate(names)]
    got = capture.dns(spark.createDataFrame(rows, "proto int, src_port int, dst_port int, payload binary"))
    assert [r.dns_qname for r in got.orderBy("dns_id").collect()] == names
