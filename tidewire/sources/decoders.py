"""Protocol fields as columns over payload bytes, beside those of capture.py. Each takes packets and returns the rows that hold its messages."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from ..operators import correlate, flows
from . import streams


def number(c: Column, at: int, size: int) -> Column:
    """Big-endian unsigned number; null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(c, at + 1, size)), F.lit("")), 16, 10).cast("long")


def icmp(packets: DataFrame) -> DataFrame:
    """ICMP errors of both families with their slug (told alike) and the 5-tuple of the packet that they are about; ``about_flows`` finds its flow.

    An IPv6 packet that an error is about is read without option headers.
    """
    six = "src_ip6" in packets.columns
    body = F.col("payload")
    p = packets.filter(F.col("proto").isin(1, 58) if six else F.col("proto") == 1).filter(F.length("payload") >= 8)
    new = F.col("proto") == 58
    out = p.withColumns({"icmp_type": number(body, 0, 1), "icmp_code": number(body, 1, 1)})
    kinds = [k(F.col("icmp_type"), F.col("icmp_code")) for k in (net.icmp6_kind, net.icmp_kind)]
    out = out.withColumn("icmp_kind", F.when(new, kinds[0]).otherwise(kinds[1]) if six else kinds[1]).filter("icmp_kind IS NOT NULL")
    inner = F.substring(body, 9, 1 << 16)
    head = F.conv(F.hex(F.substring(inner, 1, 1)), 16, 10).cast("int").bitwiseAND(F.lit(15)) * 4
    head = F.when(new, 40).otherwise(head) if six else head
    port = lambda at: F.conv(F.nullif(F.hex(F.substring(inner, head + at, F.lit(2))), F.lit("")), 16, 10).cast("long")
    four = lambda c: F.when(~new, c) if six else c
    told = {"about_src_ip4": four(number(inner, 12, 4)), "about_dst_ip4": four(number(inner, 16, 4)), "about_src_port": port(1), "about_dst_port": port(3)}
    if six:
        end = lambda at: F.when(new & (F.length(inner) >= at + 16), F.substring(inner, at + 1, 16))
        told |= {"about_proto": F.when(new, number(inner, 6, 1)).otherwise(number(inner, 9, 1)), "about_src_ip6": end(8), "about_dst_ip6": end(24)}
    else:
        told["about_proto"] = number(inner, 9, 1)
    return out.withColumns(told)


def about_flows(errors: DataFrame, flows_: DataFrame, grace_us: int, keep: list[str]) -> DataFrame:
    """ICMP errors (ts_us, about_*) with the columns ``keep`` of the flow that they are about: the latest begun one of its key
    that had not ended more than ``grace_us`` before; null without one."""
    both = "about_src_ip6" in errors.columns and "a_ip6" in flows_.columns
    fields = ("ip4", "port", "ip6") if both else ("ip4", "port")
    about = {f"{x}_{c}": F.col(f"about_{x}_{c}") for x in ("src", "dst") for c in fields} | {"proto": F.col("about_proto")}
    named = errors.select("*").withColumn("error_", F.struct(*errors.columns)).select("error_", "ts_us", *(c.alias(n) for n, c in about.items()))
    key = flows.key_of(flows_) if both else flows.KEY
    plain = lambda t: t.withColumns({c: F.coalesce(F.col(c).cast("long"), F.lit(-1)) for c in key if not c.endswith("ip6")} | {c: F.coalesce(c, F.lit(b"")) for c in key if c.endswith("ip6")})
    keyed = plain(flows.with_key(named)).select("error_", "ts_us", *key)
    periods = plain(flows_).select(*key, "start_us", (F.col("end_us") + grace_us).alias("until_us"), *(F.col(c).alias(f"flow_{c}") for c in keep))
    found = correlate.within(keyed, periods, key, "start_us", "until_us", [f"flow_{c}" for c in keep])
    return found.select("error_.*", *(f"flow_{c}" for c in keep))


def neighbour_adverts(packets: DataFrame) -> DataFrame:
    """IPv6 neighbour advertisements with a link-layer address: target, mac, and the solicited and override flags."""
    body = F.col("payload")
    p = packets.filter("proto = 58").filter((F.length(body) >= 32) & (number(body, 0, 1) == 136) & (number(body, 24, 1) == 2))
    flags = number(body, 4, 1)
    mac = F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.hex(F.substring(body, i + 27, F.lit(1)))), ":"))
    bit = lambda b: flags.bitwiseAND(F.lit(b)) != 0
    return p.select("seq", "ts_us", F.lower(F.hex(F.substring(body, 9, 16))).alias("ip"), mac.alias("mac"), bit(0x40).alias("solicited"), bit(0x20).alias("override"))


_HELLO = "sni string, alpn string, tls_version int, ciphers array<int>, extensions array<int>, curves array<int>, formats array<int>, versions array<int>, signatures array<int>, ech boolean"
#: Fixed value: the extension that carries an encrypted hello.
ECH = 0xFE0D


def hello_fields(message: bytes) -> dict | None:
    """Fields of a client hello, a handshake message with its head; None if it is none, or not whole."""
    try:
        if message[0] != 1 or len(message) < 4 + int.from_bytes(message[1:4], "big"):
            return None
        data = message[: 4 + int.from_bytes(message[1:4], "big")]
        out = {"tls_version": struct.unpack_from(">H", data, 4)[0], "sni": None, "alpn": None, "curves": [], "formats": [], "extensions": [], "versions": [], "signatures": [], "ech": False}
        at = 38
        at += 1 + data[at]
        n = struct.unpack_from(">H", data, at)[0]
        out["ciphers"] = list(struct.unpack_from(f">{n // 2}H", data, at + 2))
        at += 2 + n
        at += 1 + data[at]
        end = at + 2 + struct.unpack_from(">H", data, at)[0] if at + 2 <= len(data) else at
        if end > len(data):
            return None
        at += 2
        while at + 4 <= end:
            kind, n = struct.unpack_from(">HH", data, at)
            body = data[at + 4 : at + 4 + n]
            if at + 4 + n > end:
                return None
            out["extensions"].append(kind)
            if kind == 0 and n > 5:
                out["sni"] = body[5 : 5 + struct.unpack_from(">H", body, 3)[0]].decode("ascii", "replace").lower()
            elif kind == 16 and n > 3:
                out["alpn"] = body[3 : 3 + body[2]].decode("ascii", "replace")
            elif kind == 10 and n > 2:
                out["curves"] = list(struct.unpack_from(f">{(n - 2) // 2}H", body, 2))
            elif kind == 11 and n > 1:
                out["formats"] = list(body[1 : 1 + body[0]])
            elif kind == 13 and n > 2:
                out["signatures"] = list(struct.unpack_from(f">{(n - 2) // 2}H", body, 2))
            elif kind == 43 and n > 2:
                out["versions"] = list(struct.unpack_from(f">{(n - 1) // 2}H", body, 1))
            elif kind == ECH:
                out["ech"] = True
            at += 4 + n
        return out
    except (IndexError, struct.error):
        return None


def client_hello(payload: bytes) -> dict | None:
    """The client hello that a payload begins with, joined over its records; None without a whole one."""
    found = streams.handshakes()(payload)[1] if payload else []
    return hello_fields(found[0][1]) if found else None


def tls_streams(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Client hellos of TCP streams, whatever segments and records they came in: by, conn, ts_us and the columns of ``tls``. Each connection of a reused 5-tuple has its own."""
    by = streams.side_of(packets) if by is None else by
    found = streams.messages(packets, streams.handshakes, "kind long, payload binary", by, head=streams.HEAD).filter("nth = 0 AND kind = 1")
    return _hellos(found, hello_fields).drop("kind", "payload", "nth")


def tls(packets: DataFrame) -> DataFrame:
    """Client hellos that lie whole in one payload of (proto, payload, ...), in one record or several: server name, first application protocol, whether it hides
    another hello (``ech``), and the fingerprints JA3 and JA4. Hellos in several segments are read by ``tls_streams``.
    """
    return _hellos(packets.filter("proto = 6").filter((number(F.col("payload"), 0, 1) == 22) & (number(F.col("payload"), 5, 1) == 1)), client_hello)


def _hellos(rows: DataFrame, read: Callable[[bytes], dict | None], transport: str = "t") -> DataFrame:
    names = [f.split()[0] for f in _HELLO.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.list_(pa.int32())] * 6, pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read(x or b"") for x in batch.column(batch.schema.get_field_index("payload")).to_pylist()]
            keep = pa.array([g is not None for g in got])
            rows = batch.filter(keep)
            got = [g for g in got if g is not None]
            yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True))], [*rows.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), _HELLO])
    out = rows.mapInArrow(run, schema).withColumn("ja3", net.ja3(F.col("tls_version"), F.col("ciphers"), F.col("extensions"), F.col("curves"), F.col("formats")))
    return out.withColumn("ja4", net.ja4(*(F.col(c) for c in ("tls_version", "versions", "ciphers", "extensions", "signatures", "alpn")), transport))


def app_label(port: Column, overrides: dict[int, str] | None = None) -> Column:
    """Application by well-known port; other ports are null."""
    table = {22: "ssh", 25: "smtp", 53: "dns", 80: "http", 123: "ntp", 161: "snmp", 389: "ldap", 443: "tls", 445: "smb", 587: "smtp", 853: "dot", 1883: "mqtt", 3389: "rdp", 8080: "http", 8443: "tls"} | (overrides or {})
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), port.cast("int"))
