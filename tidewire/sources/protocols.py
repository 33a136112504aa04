"""More protocol decoders: DNS answers, secure shell, DHCP, LLDP, network time, STUN and WireGuard. Each takes packets and returns the rows that hold its messages."""

from __future__ import annotations

import ipaddress
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net
from . import capture, streams
from .decoders import number

#: Types of DNS records whose data is told.
RECORD_TYPES = {1: "A", 5: "CNAME", 28: "AAAA"}
#: Kinds of DHCP messages.
DHCP_KINDS = {1: "discover", 2: "offer", 3: "request", 4: "decline", 5: "ack", 6: "nak", 7: "release", 8: "inform"}


def _name(data: bytes, at: int) -> tuple[str, int]:
    """The name at a place, through pointers, and where what comes after it begins. Pointers lead backwards only, so the walk ends."""
    labels, after, least = [], None, at
    while True:
        n = data[at]
        if n >= 192:
            to = struct.unpack_from(">H", data, at)[0] & 0x3FFF
            after = at + 2 if after is None else after
            if to >= least:
                raise ValueError("a pointer forwards")
            at = least = to
        elif n >= 64:
            raise ValueError("a reserved kind of label")
        elif n:
            labels.append(data[at + 1 : at + 1 + n].decode("ascii", "replace").lower())
            at += 1 + n
        else:
            return ".".join(labels), at + 1 if after is None else after


def answers(data: bytes) -> list[tuple[int, str | None, str, int, int, str | None]]:
    """(id, first question, name, type, seconds to live, value) of each answer of a DNS message; those before a broken one are told."""
    out = []
    try:
        number_, flags, questions, count = struct.unpack_from(">HHHH", data)
        if not flags & 0x8000:
            return out
        at, asked = 12, None
        for _ in range(questions):
            name, at = _name(data, at)
            asked, at = name if asked is None else asked, at + 4
        for _ in range(count):
            name, at = _name(data, at)
            kind, _, ttl, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            body = data[at : at + size]
            if len(body) < size:
                break
            value = None
            if kind == 1 and size == 4 or kind == 28 and size == 16:
                value = str(ipaddress.ip_address(body))
            elif kind == 5:
                value = _name(data, at)[0]
            out.append((number_, asked, name, kind, ttl, value))
            at += size
    except (IndexError, struct.error, ValueError):
        pass
    return out


def dns_answers(packets: DataFrame) -> DataFrame:
    """``answers_of`` DNS over UDP; over TCP: of ``dns_streams``."""
    return answers_of(packets.filter("proto = 17").filter(F.col("src_port").isin(*capture.DNS_PORTS) | F.col("dst_port").isin(*capture.DNS_PORTS)))


def dns_streams(packets: DataFrame, by: list[str] | None = None, ports: tuple[int, ...] = (53,)) -> DataFrame:
    """DNS messages over TCP: by, conn, nth, ts_us, payload; for ``capture.dns_message`` and ``answers_of``. Segments may cut messages anywhere, their lengths too."""
    p = packets.filter(F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports)) if "src_port" in packets.columns else packets
    return streams.messages(p, streams.prefixed(2, least=12), "payload binary", by)


def answers_of(messages: DataFrame) -> DataFrame:
    """A row an answer of DNS messages: the message's columns but its payload, dns_id, dns_qname (the first question), answer_name, answer_type, answer_ttl and
    answer_value: the address, or the name that an alias stands for; null for other types, whose number is their type.
    """
    kept = [f for f in messages.schema.fields if f.name != "payload"]
    p = messages.select(*(f.name for f in kept), "payload")
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["dns_id", "dns_qname", "answer_name", "answer_type", "answer_ttl", "answer_value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(i, *a) for i, data in enumerate(batch.column(len(kept)).to_pylist()) for a in answers(data or b"")]
            if told:
                at, ids, asked, name, kind, ttl, value = zip(*told, strict=True)
                rows = batch.take(pa.array(at, pa.int64()))
                more = (ids, asked, name, [RECORD_TYPES.get(k, str(k)) for k in kind], ttl, value)
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *(pa.array(c, t) for c, t in zip(more, kinds, strict=True))], [*(f.name for f in kept), *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "dns_id int, dns_qname string, answer_name string, answer_type string, answer_ttl long, answer_value string"])
    return p.mapInArrow(run, schema)


def ssh(packets: DataFrame) -> DataFrame:
    """Secure shell banners at the start of payloads over TCP: ssh_version, ssh_software, ssh_comment."""
    return _banners(packets.filter("proto = 6"))


def _banners(lines: DataFrame) -> DataFrame:
    line = F.regexp_extract(F.decode("payload", "ISO-8859-1"), r"^SSH-([0-9.]+)-([^\s]+)(?: ([^\r\n]*))?\r?\n", 0)
    part = lambda k: F.nullif(F.regexp_extract("line_", r"^SSH-([0-9.]+)-([^\s]+)(?: ([^\r\n]*))?\r?\n", k), F.lit(""))
    p = lines.withColumn("line_", line).filter("line_ <> ''")
    return p.withColumns({"ssh_version": part(1), "ssh_software": part(2), "ssh_comment": part(3)}).drop("line_")


def ssh_kex(packets: DataFrame) -> DataFrame:
    """Offers of algorithms that are whole payloads over TCP; those in several segments, or behind a banner, are read by ``ssh_streams``."""
    return _offers(packets.filter("proto = 6"))


def ssh_streams(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Banners and offers of secure shell streams, in whatever segments they came: by, conn, ts_us, what ("banner", "offer"), and the columns of ``ssh`` and ``ssh_kex``."""
    found = streams.messages(packets, streams.shell, "what string, payload binary", by, head=streams.HEAD)
    told = _banners(found.filter("what = 'banner'")).unionByName(_offers(found.filter("what = 'offer'")), allowMissingColumns=True)
    return told.drop("payload", "nth")


def _offers(packets: DataFrame) -> DataFrame:
    """Payloads that begin a key exchange: the ten lists as ``ssh_lists``, and HASSH of them read as a client's and as a server's."""
    body = F.col("payload")
    begin = F.struct(F.lit(22).cast("long").alias("at"), F.array().cast("array<array<string>>").alias("lists"))

    def more(a: Column, _: Column) -> Column:
        size = F.coalesce(number(body, a["at"], 4), F.lit(0))
        text = F.decode(F.substring(body, (a["at"] + 5).cast("int"), size.cast("int")), "ISO-8859-1")
        return F.struct((a["at"] + 4 + size).alias("at"), F.array_append(a["lists"], F.filter(F.split(text, ","), lambda x: x != "")).alias("lists"))

    p = packets.filter((F.length(body) > 22) & (number(body, 5, 1) == 20) & (number(body, 0, 4) <= F.length(body) - 4))
    p = p.withColumn("ssh_lists", F.aggregate(F.sequence(F.lit(1), F.lit(10)), begin, more, lambda a: a["lists"]))
    one = lambda k: F.get("ssh_lists", F.lit(k))
    return p.withColumns({"hassh": net.hassh(one(0), one(2), one(4), one(6)), "hassh_server": net.hassh(one(0), one(3), one(5), one(7))})


def _elements(body: Column, start: int, most: Column, read: Callable[[Column], tuple[Column, Column, Column]]) -> Column:
    """(kind, value) of the elements of a body from a place on. ``read`` tells of a place the kind (null at the end), the bytes of head and of value."""
    begin = F.struct(F.lit(start).cast("long").alias("at"), F.array().cast("array<struct<kind:bigint,value:binary>>").alias("found"))

    def step(a: Column, _: Column) -> Column:
        kind, head, size = read(a["at"])
        value = F.substring(body, (a["at"] + head + 1).cast("int"), size.cast("int"))
        there = kind.isNotNull() & (a["at"] + head + size <= F.length(body))
        found = F.array_append(a["found"], F.struct(kind.alias("kind"), value.alias("value")))
        return F.when(there, F.struct((a["at"] + head + size).alias("at"), found.alias("found"))).otherwise(a)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), most.cast("int"))), begin, step, lambda a: a["found"])


def _element(name: str, kind: int) -> Column:
    return F.get(F.filter(name, lambda e: e["kind"] == kind), F.lit(0))["value"]


def _mac(c: Column) -> Column:
    return F.when(F.length(c) == 6, F.lower(F.regexp_replace(F.hex(c), "(..)(?=.)", "$1:")))


def _ip4(c: Column) -> Column:
    return F.when(F.length(c) == 4, net.ip4_text(F.conv(F.hex(c), 16, 10).cast("long")))


def dhcp(packets: DataFrame) -> DataFrame:
    """DHCP messages over UDP: dhcp_kind, the client's mac, hostname and vendor class, the address it asks for and the one it is given."""
    body = F.col("payload")
    p = packets.filter("proto = 17 AND (src_port IN (67, 68) OR dst_port IN (67, 68))").filter((F.length(body) >= 240) & (F.hex(F.substring(body, 237, 4)) == "63825363"))

    def read(at: Column) -> tuple[Column, Column, Column]:
        code = number(body, at, 1)
        padding = code == 0
        return F.when(code != 255, code), F.when(padding, 1).otherwise(2), F.when(padding, 0).otherwise(F.coalesce(number(body, at + 1, 1), F.lit(0)))

    p = p.withColumn("options_", _elements(body, 240, F.length(body) - 240, read))
    text = lambda k: F.decode(_element("options_", k), "ISO-8859-1")
    kind = number(_element("options_", 53), 0, 1)
    kinds = F.create_map(*(F.lit(x) for kv in DHCP_KINDS.items() for x in kv))
    given = _ip4(F.substring(body, 17, 4))
    told = {"dhcp_kind": F.try_element_at(kinds, kind.cast("int")), "client_mac": _mac(F.substring(body, 29, 6)), "hostname": text(12), "vendor_class": text(60), "asked_ip": _ip4(_element("options_", 50)), "given_ip": F.nullif(given, F.lit("0.0.0.0"))}
    return p.withColumns(told).drop("options_")


def lldp(packets: DataFrame) -> DataFrame:
    """Link-layer discovery frames: chassis (a mac, else hex), port, seconds to live, the system's name and description."""
    body = F.col("payload")

    def read(at: Column) -> tuple[Column, Column, Column]:
        head = number(body, at, 2)
        kind = F.shiftright(head, 9)
        return F.when((F.length(body) >= at + 2) & (kind != 0), kind), F.lit(2), F.coalesce(head.bitwiseAND(F.lit(511)), F.lit(0))

    p = packets.filter("ethertype = 35020").withColumn("elements_", _elements(body, 0, F.length(body) / 2, read))
    rest = lambda k: F.substring(_element("elements_", k), 2, 1 << 9)
    text = lambda c: F.decode(c, "UTF-8")
    mac = number(_element("elements_", 1), 0, 1) == 4
    told = {"chassis": F.when(mac, _mac(rest(1))).otherwise(F.lower(F.hex(rest(1)))), "port": F.when(number(_element("elements_", 2), 0, 1) == 3, _mac(rest(2))).otherwise(text(rest(2)))}
    told |= {"ttl": number(_element("elements_", 3), 0, 2), "system_name": text(_element("elements_", 5)), "system_text": text(_element("elements_", 6))}
    return p.withColumns(told).drop("elements_")


def ntp(packets: DataFrame) -> DataFrame:
    """Network time over UDP: version, mode (3 asks, 4 answers) and stratum."""
    first = number(F.col("payload"), 0, 1)
    p = packets.filter("proto = 17 AND (src_port = 123 OR dst_port = 123)").filter(F.length("payload") >= 48)
    return p.withColumns({"ntp_version": F.shiftright(first, 3).bitwiseAND(F.lit(7)), "ntp_mode": first.bitwiseAND(F.lit(7)), "ntp_stratum": number(F.col("payload"), 1, 1)})


def stun(packets: DataFrame) -> DataFrame:
    """STUN messages over UDP, told by their cookie: the method, and the class (request, indication, success, error)."""
    body = F.col("payload")
    kind = number(body, 0, 2)
    bits = F.shiftright(kind, 7).bitwiseAND(F.lit(2)).bitwiseOR(F.shiftright(kind, 4).bitwiseAND(F.lit(1)))
    method = F.shiftright(kind, 2).bitwiseAND(F.lit(0xF80)).bitwiseOR(F.shiftright(kind, 1).bitwiseAND(F.lit(0x70))).bitwiseOR(kind.bitwiseAND(F.lit(15)))
    p = packets.filter("proto = 17").filter((F.length(body) >= 20) & (F.hex(F.substring(body, 5, 4)) == "2112A442") & (kind < 0x4000) & (number(body, 2, 2) == F.length(body) - 20))
    return p.withColumns({"stun_method": method, "stun_class": F.element_at(F.array(*map(F.lit, ("request", "indication", "success", "error"))), (bits + 1).cast("int"))})


def wireguard(packets: DataFrame) -> DataFrame:
    """WireGuard messages over UDP by their kind and size: initiation, response, cookie or data."""
    body, size = F.col("payload"), F.length("payload")
    kind = F.when(F.hex(F.substring(body, 2, 3)) == "000000", number(body, 0, 1))
    told = F.when((kind == 1) & (size == 148), "initiation").when((kind == 2) & (size == 92), "response").when((kind == 3) & (size == 64), "cookie").when((kind == 4) & (size >= 32) & (size % 16 == 0), "data")
    return packets.filter("proto = 17").withColumn("wireguard", told).filter("wireguard IS NOT NULL")
