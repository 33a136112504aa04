"""Directory, file, management and control protocols out of bytes made by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from tests.test_streams import sent, table
from tidewire.sources import services


def tlv(tag, *parts):
    body = b"".join(parts)
    return bytes([tag]) + (bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))) + body


def names(*parts):
    return tlv(0x30, tlv(0xA0, b"\x02\x01\x01"), tlv(0xA1, tlv(0x30, *(tlv(0x1B, p) for p in parts))))


def tgs(etypes):
    body = tlv(0x30, tlv(0xA0, b"\x03\x05\0\x40\0\0\0"), tlv(0xA2, tlv(0x1B, b"EXAMPLE")), tlv(0xA3, names(b"HTTP", b"web")), tlv(0xA8, tlv(0x30, *(tlv(2, bytes([e])) for e in etypes))))
    return tlv(0x6C, tlv(0x30, tlv(0xA1, b"\x02\x01\x05"), tlv(0xA2, b"\x02\x01\x0c"), tlv(0xA4, body)))


def error(code):
    return tlv(0x7E, tlv(0x30, tlv(0xA0, b"\x02\x01\x05"), tlv(0xA1, b"\x02\x01\x1e"), tlv(0xA6, tlv(2, bytes([code]))), tlv(0xA9, tlv(0x1B, b"EXAMPLE")), tlv(0xAA, names(b"krbtgt", b"EXAMPLE"))))


def on(port, source=4000):
    return (1, source, 2, port)


def framed(data, size=4):
    return len(data).to_bytes(size, "big") + data


@pytest.mark.parametrize("size", [1, 30, 5000])
def test_kerberos(spark, size):
    data = framed(tgs([23, 17])) + framed(error(24)) + framed(b"\x30\x00") + framed(tgs([18]))
    got = services.kerberos(table(spark, sent(data, 3, ends=on(88), size=size, shuffle=size))).orderBy("nth").collect()
    assert [(r.kerberos_type, r.kerberos_service, r.kerberos_etype, r.kerberos_error) for r in got] == [("TGS-REQ", "HTTP/web", 23, None), ("KRB-ERROR", "krbtgt/EXAMPLE", None, 24), ("TGS-REQ", "HTTP/web", 18, None)]
    udp = table(spark, sent(error(18), 3, ends=on(88), size=5000)).withColumn("proto", F.lit(17))
    assert [r.kerberos_error for r in services.kerberos_datagrams(udp).collect()] == [18]


def search(filter_):
    return tlv(0x30, b"\x02\x01\x07", tlv(0x63, tlv(4, b"dc=a"), b"\x0a\x01\x02\x0a\x01\x00\x02\x01\x00\x02\x01\x00\x01\x01\x00", filter_, tlv(0x30, tlv(4, b"cn"))))


def test_ldap(spark):
    both = tlv(0xA0, tlv(0x87, b"servicePrincipalName"), tlv(0xA2, tlv(0xA3, tlv(4, b"cn"), tlv(4, b"x" * 150))), tlv(0xA4, tlv(4, b"mail"), tlv(0x30, tlv(0x80, b"a"), tlv(0x81, b"b"), tlv(0x82, b"c"))))
    deep = tlv(0x87, b"a")
    for _ in range(80):
        deep = tlv(0xA2, deep)
    data = search(both) + tlv(0x30, b"\x02\x01\x08", tlv(0x60, b"\x02\x01\x03", tlv(4, b"cn=me"), tlv(0x80, b"pw"))) + search(deep) + tlv(0x30, b"\x02\x01\x09", tlv(0x65, b"\x0a\x01\x20", tlv(4), tlv(4)))
    got = services.ldap(table(spark, sent(data, 3, ends=on(389), size=41))).orderBy("nth").collect()
    assert got[0].ldap_filter == f"(&(servicePrincipalName=*)(!(cn={'x' * 150}))(mail=a*b*c))" and (got[0].ldap_base, got[0].ldap_scope) == ("dc=a", 2)
    assert (got[1].ldap_op, got[1].ldap_base) == ("bind", "cn=me") and "(...)" in got[2].ldap_filter and (got[3].ldap_op, got[3].ldap_result) == ("done", 32)


def smb(command, body, following=0, answer=0):
    return b"\xfeSMB" + struct.pack("<HHIHHII", 64, 0, 5, command, 0, answer, following) + bytes(40) + body


def test_smb(spark):
    path, pipe = r"\\host\ADMIN$".encode("utf-16-le"), "svcctl".encode("utf-16-le")
    one = smb(3, struct.pack("<HHHH", 9, 0, 72, len(path)) + path)
    one += bytes(-len(one) % 8)
    two = smb(5, struct.pack("<H", 57) + bytes(42) + struct.pack("<HH", 120, len(pipe)) + bytes(8) + pipe)
    both = one[:20] + struct.pack("<I", len(one)) + one[24:] + two
    data = framed(both) + b"\x85\0\0\0" + framed(smb(0, b"", answer=1))
    got = services.smb(table(spark, sent(data, 3, ends=on(445), size=33))).orderBy("nth").collect()
    assert [(r.smb_command, r.smb_share, r.smb_pipe, r.smb_answer, r.smb_status) for r in got] == [("tree_connect", "ADMIN$", None, 0, None), ("create", None, "svcctl", 0, None), ("negotiate", None, None, 1, 5)]


def test_rdp(spark):
    cookie = b"Cookie: mstshash=alice\r\n\x01\0\x08\0\x03\0\0\0"
    data = b"\x03\0" + struct.pack(">H", 11 + len(cookie)) + bytes([6 + len(cookie)]) + b"\xe0\0\0\0\0\0" + cookie + b"more"
    got = services.rdp(table(spark, sent(data, 3, ends=on(3389), size=5))).collect()
    assert [(r.rdp_kind, r.rdp_user, r.rdp_protocols) for r in got] == [("request", "alice", 3)]
    both = services.windows(table(spark, sent(data, 3, ends=on(3389)), sent(framed(tgs([23])), 9, ends=on(88)))).collect()
    assert sorted((r.rdp_user or "", r.kerberos_etype or 0) for r in both) == [("", 23), ("alice", 0)]


def datagrams(spark, port, *payloads):
    return spark.createDataFrame([(i, i, 17, 1, 9999, 2, port, p) for i, p in enumerate(payloads)], "seq long, ts_us long, proto int, src_ip4 long, src_port int, dst_ip4 long, dst_port int, payload binary")


def test_datagrams(spark):
    got = services.snmp(datagrams(spark, 161, tlv(0x30, b"\x02\x01\x01", tlv(4, b"public"), tlv(0xA5, b"\x02\x01\x01")), b"\x30", None)).collect()
    assert [(r.snmp_version, r.snmp_community, r.snmp_op) for r in got] == [("2c", "public", "get_bulk")]
    body = bytes([1, 7]) + b"alice" + bytes([31, 4]) + b"ab"
    got = services.radius(datagrams(spark, 1812, b"\x01\x09" + struct.pack(">H", 20 + len(body)) + bytes(16) + body, b"\x01\x01\0\x10")).collect()
    assert [(r.radius_kind, r.radius_id, r.radius_user, r.radius_station) for r in got] == [("access_request", 9, "alice", "ab")]
    assert [(r.tftp_op, r.tftp_file, r.tftp_mode) for r in services.tftp(datagrams(spark, 69, b"\0\1boot.bin\0OCTET\0", b"\0\3\0\1")).collect()] == [("read", "boot.bin", "octet")]
    got = services.ssdp(datagrams(spark, 1900, b"M-SEARCH * HTTP/1.1\r\nST: ssdp:all\r\n\r\n", b"x")).collect()
    assert [(r.ssdp_kind, r.ssdp_target) for r in got] == [("M-SEARCH", "ssdp:all")]
    coded = b"".join(bytes([65 + (c >> 4), 65 + (c & 15)]) for c in b"HOST".ljust(15) + b"\x20")
    got = services.netbios_names(datagrams(spark, 137, struct.pack(">HHHHHH", 7, 0x0110, 1, 0, 0, 0) + b"\x20" + coded + b"\0\0\x20\0\1", b"\0" * 50)).collect()
    assert [(r.nbns_id, r.nbns_answer, r.nbns_name, r.nbns_suffix) for r in got] == [(7, 0, "HOST", 32)]
    assert [(r.dnp3_dst, r.dnp3_src, r.dnp3_link) for r in services.dnp3(datagrams(spark, 20000, bytes.fromhex("056405c40100020071ab"))).collect()] == [(1, 2, 4)]


def test_control_and_commands(spark):
    units = struct.pack(">HHHBBB", 1, 0, 6, 9, 3, 0) + bytes(3) + struct.pack(">HHHBBB", 2, 0, 3, 9, 0x83, 2)
    got = services.modbus(table(spark, sent(units, 3, ends=on(502), size=4))).orderBy("nth").collect()
    assert [(r.modbus_id, r.modbus_unit, r.modbus_function, r.modbus_exception) for r in got] == [(1, 9, 3, None), (2, 9, 3, 2)]
    got = services.commands(table(spark, sent(b"220-ready\r\nUSER alice\r\nMAIL FROM:<a@b>\nQUIT\r\n", 3, ends=on(25), size=6))).orderBy("nth").collect()
    assert [(r.reply, r.command, r.argument) for r in got] == [(220, None, "ready"), (None, "USER", "alice"), (None, "MAIL", "FROM:<a@b>"), (None, "QUIT", None)]


def test_applications(spark):
    rows = spark.createDataFrame([(443, "www.video.example", "h2"), (443, "dns.google", "h2"), (443, None, "h3"), (22, None, None), (1, None, "zz"), (443, "video.example.org", None)], "dst_port int, sni string, alpn string")
    got = [r.app for r in services.application(rows, {"video.example": "video", "example": "other"}).collect()]
    assert got == ["video", "doh", "http3", "ssh", None, "tls"]
