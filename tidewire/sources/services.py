"""Decoders of directory, file, management and control protocols: nested tag-length-value messages, framed streams and datagrams.

Over TCP messages are cut out of ordered streams, so segments do not matter; each decoder gives by, conn, nth, ts_us and its fields. Over UDP a packet is a message.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import net
from . import streams
from .decoders import app_label, number

_KINDS = {"bigint": pa.int64(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}


def parsed(rows: DataFrame, read: Callable[[bytes], dict | None], schema: str) -> DataFrame:
    """rows without their payload, with the fields that ``read`` tells of it; rows of which it tells none, or that break it, are left out."""
    fields = T._parse_datatype_string(schema).fields
    kept = [f for f in rows.schema.fields if f.name != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, told = [], []
            for i, data in enumerate(batch.column(len(kept)).to_pylist()):
                try:
                    got = read(data) if data else None
                except (IndexError, struct.error, ValueError):
                    got = None
                if got is not None:
                    at.append(i)
                    told.append(got)
            if at:
                own = batch.take(pa.array(at, pa.int64())).columns[: len(kept)]
                more = [pa.array([t.get(f.name) for t in told], _KINDS[f.dataType.simpleString()]) for f in fields]
                yield pa.RecordBatch.from_arrays([*own, *more], [*(f.name for f in kept), *(f.name for f in fields)])

    return rows.select(*(f.name for f in kept), "payload").mapInArrow(run, T.StructType([*kept, *fields]))


def _on(packets: DataFrame, proto: int, *ports: int) -> DataFrame:
    return packets.filter(F.col("proto") == proto).filter(F.col("src_port").isin(*ports) | F.col("dst_port").isin(*ports))


# Nested elements: tag, length, value.


def element(data: bytes, at: int, end: int | None = None) -> tuple[int, int, int]:
    """Tag, start and end of the value of the element at a place; lengths of one to four more bytes. Tags of several bytes and open lengths are not used by these protocols."""
    end = len(data) if end is None else end
    tag, size, at = data[at], data[at + 1], at + 2
    if tag & 31 == 31 or size == 128 or size > 132:
        raise ValueError("an element of another form")
    if size > 128:
        n = size & 127
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > end:
        raise ValueError("an element longer than what holds it")
    return tag, at, at + size


def elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end:
        out.append(element(data, at, end))
        at = out[-1][2]
    return out


def inner(data: bytes, span: tuple[int, int], *tags: int) -> tuple[int, int] | None:
    """The span of the value that a path of tags leads to; None if it ends before."""
    for tag in tags:
        span = next(((a, b) for t, a, b in elements(data, *span) if t == tag), None)
        if span is None:
            return None
    return span


def _int(data: bytes, span: tuple[int, int] | None) -> int | None:
    return None if span is None else int.from_bytes(data[span[0] : span[1]], "big", signed=True)


def _text(data: bytes, span: tuple[int, int] | None) -> str | None:
    return None if span is None else data[span[0] : span[1]].decode("utf-8", "replace")


def nested() -> streams.Reader:
    """Elements one after the other, each a message."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while at + 2 <= len(data):
            n = data[at + 1] & 127 if data[at + 1] > 128 else 0
            if data[at] != 0x30 or n > 4 or data[at + 1] == 128:
                return at, found, False
            if at + 2 + n > len(data):
                break
            size = int.from_bytes(data[at + 2 : at + 2 + n], "big") if n else data[at + 1]
            if at + 2 + n + size > len(data):
                break
            found.append((data[at : at + 2 + n + size],))
            at += 2 + n + size
        return at, found, True

    return read


#: Application tags of Kerberos messages.
KERBEROS = {10: "AS-REQ", 11: "AS-REP", 12: "TGS-REQ", 13: "TGS-REP", 14: "AP-REQ", 15: "AP-REP", 30: "KRB-ERROR"}
_KERBEROS = "kerberos_type string, kerberos_client string, kerberos_service string, kerberos_realm string, kerberos_etypes array<long>, kerberos_error long"


def kerberos_message(data: bytes) -> dict | None:
    tag, *span = element(data, 0)
    kind = KERBEROS.get(tag & 31) if tag & 0xE0 == 0x60 else None
    if kind is None:
        return None
    span = inner(data, tuple(span), 0x30)
    if span is None:
        return None
    context = lambda *path: inner(data, body, *(0xA0 | p for p in path))

    def name(field: int) -> str | None:
        parts = inner(data, body, 0xA0 | field, 0x30, 0xA1, 0x30)
        return None if parts is None else "/".join(_text(data, (a, b)) for _, a, b in elements(data, *parts))

    inside = lambda s: None if s is None else element(data, s[0])[1:]
    out = {"kerberos_type": kind}
    if kind.endswith("-REQ") and kind != "AP-REQ":
        body = inner(data, span, 0xA4, 0x30)
        if body is None:
            return None
        offered = inner(data, body, 0xA8, 0x30)
        etypes = [_int(data, (a, b)) for _, a, b in elements(data, *offered)] if offered else None
        return out | {"kerberos_client": name(1), "kerberos_service": name(3), "kerberos_realm": _text(data, inside(context(2))), "kerberos_etypes": etypes}
    body = span
    if kind == "KRB-ERROR":
        return out | {"kerberos_client": name(8), "kerberos_service": name(10), "kerberos_realm": _text(data, inside(context(9))), "kerberos_error": _int(data, inside(context(6)))}
    if kind.endswith("-REP") and kind != "AP-REP":
        ticket = inner(data, body, 0xA5, 0x61, 0x30, 0xA3, 0x30, 0xA0)  # the ticket's own encryption
        return out | {"kerberos_client": name(4), "kerberos_realm": _text(data, inside(context(3))), "kerberos_etypes": None if ticket is None else [_int(data, inside(ticket))]}
    return out


def kerberos(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Kerberos messages over TCP (port 88): their type, client, service, realm, the encryption types asked for (of answers the ticket's), and the code of an error."""
    return parsed(streams.messages(_on(packets, 6, 88), streams.prefixed(4, least=2), "payload binary", by), kerberos_message, _KERBEROS).withColumn("kerberos_etype", F.get("kerberos_etypes", F.lit(0)))


def kerberos_datagrams(packets: DataFrame) -> DataFrame:
    """The same over UDP; the packets' columns but their payload."""
    return parsed(_on(packets, 17, 88), kerberos_message, _KERBEROS).withColumn("kerberos_etype", F.get("kerberos_etypes", F.lit(0)))


#: Operations of directory messages, and of a search filter.
LDAP = {0: "bind", 1: "bind_answer", 2: "unbind", 3: "search", 4: "entry", 5: "done", 6: "modify", 8: "add", 10: "delete", 12: "rename", 14: "compare", 16: "abandon", 19: "reference", 23: "extended", 24: "extended_answer"}
_COMPARES = {3: "=", 5: ">=", 6: "<=", 8: "~="}
#: Filters nested deeper are told as "...".
DEEPEST = 50


def _filter(data: bytes, at: int, end: int, depth: int = 0) -> tuple[str, int]:
    tag, a, b = element(data, at, end)
    op = tag & 31
    if depth > DEEPEST:
        return "(...)", b
    if op in (0, 1, 2):
        parts, place = [], a
        while place < b:
            text, place = _filter(data, place, b, depth + 1)
            parts.append(text)
        return "(" + "&|!"[op] + "".join(parts) + ")", b
    if op == 7:
        return f"({_text(data, (a, b))}=*)", b
    if op in _COMPARES:
        (_, *x), (_, *y) = elements(data, a, b)[:2]
        return f"({_text(data, x)}{_COMPARES[op]}{_text(data, y)})", b
    if op == 4:
        (_, *x), (_, *y) = elements(data, a, b)[:2]
        parts = elements(data, *y)
        text = "*".join([*([""] if parts and parts[0][0] & 31 else []), *(_text(data, (c, d)) for _, c, d in parts), *([""] if parts and parts[-1][0] & 31 != 2 else [])])
        return f"({_text(data, x)}={text})", b
    return "(:=)", b


def ldap_message(data: bytes) -> dict | None:
    span = element(data, 0)[1:]
    parts = elements(data, *span)
    if len(parts) < 2 or parts[0][0] != 2 or parts[1][0] & 0xC0 != 0x40:
        return None
    tag, a, b = parts[1]
    out = {"ldap_id": _int(data, parts[0][1:]), "ldap_op": LDAP.get(tag & 31, str(tag & 31))}
    own = elements(data, a, b) if tag & 0x20 else []
    if tag & 31 == 3 and len(own) >= 7:
        out |= {"ldap_base": _text(data, own[0][1:]), "ldap_scope": _int(data, own[1][1:])}
        out["ldap_filter"] = _filter(data, own[5][2], b)[0]
    elif tag & 31 == 0 and len(own) >= 3:
        out |= {"ldap_base": _text(data, own[1][1:])}
    elif tag & 31 in (1, 5) and own:
        out["ldap_result"] = _int(data, own[0][1:])
    return out


def ldap(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Directory messages over TCP (ports 389, 3268): id, operation, base (a bind's name), scope and filter of searches, and the result of answers."""
    m = streams.messages(_on(packets, 6, 389, 3268), nested, "payload binary", by)
    return parsed(m, ldap_message, "ldap_id long, ldap_op string, ldap_base string, ldap_scope long, ldap_filter string, ldap_result long")


#: Commands of file sharing, in order.
SMB = "negotiate session_setup logoff tree_connect tree_disconnect create close flush read write lock ioctl cancel echo query_directory change_notify query_info set_info oplock_break".split()


def sessions() -> streams.Reader:
    """Messages after a byte of type and three of length; types other than messages are passed over."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while at + 4 <= len(data):
            size = int.from_bytes(data[at + 1 : at + 4], "big")
            if data[at] not in (0, 0x81, 0x82, 0x83, 0x84, 0x85):
                return at, found, False
            if at + 4 + size > len(data):
                break
            if data[at] == 0 and data[at + 4 : at + 8] == b"\xfeSMB":
                found += [(x,) for x in _compound(data[at + 4 : at + 4 + size])]
            at += 4 + size
        return at, found, True

    return read


def _compound(data: bytes) -> list[bytes]:
    """The messages that one may be made of."""
    out = []
    while len(data) >= 64:
        following = int.from_bytes(data[20:24], "little")
        out.append(data[:following] if 64 <= following < len(data) else data)
        if out[-1] is data:
            break
        data = data[following:]
    return out


def smb_message(data: bytes) -> dict | None:
    if data[:4] != b"\xfeSMB" or len(data) < 64:
        return None
    status, command = struct.unpack_from("<IH", data, 8)
    answer = data[16] & 1
    out = {"smb_command": SMB[command] if command < len(SMB) else str(command), "smb_answer": answer, "smb_status": status if answer else None}
    if not answer and command in (3, 5):
        at, size = struct.unpack_from("<HH", data, 68 if command == 3 else 64 + 44)
        name = data[at : at + size].decode("utf-16-le", "replace")
        if command == 3:
            out |= {"smb_path": name, "smb_share": name.rsplit("\\", 1)[-1]}
        else:
            out |= {"smb_path": name, "smb_pipe": name.rsplit("\\", 1)[-1]}
    return out


def smb(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """File sharing messages (version 2 and 3, in the clear) over TCP (port 445): command, whether an answer and its status, the path of a tree or file, its last part as smb_share or smb_pipe."""
    m = streams.messages(_on(packets, 6, 445), sessions, "payload binary", by)
    return parsed(m, smb_message, "smb_command string, smb_answer long, smb_status long, smb_path string, smb_share string, smb_pipe string")


def _first_unit() -> streams.Reader:
    """The first unit of a remote desktop's stream."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        if len(data) < 4:
            return 0, [], data[:1] in (b"", b"\x03")
        size = int.from_bytes(data[2:4], "big")
        if data[0] != 3 or size < 7:
            return 0, [], False
        return (0, [], True) if len(data) < size else (size, [(data[:size],)], False)

    return read


def rdp_message(data: bytes) -> dict | None:
    kind = {0xE0: "request", 0xD0: "confirm"}.get(data[5] & 0xF0)
    if kind is None:
        return None
    rest = data[11:]
    out = {"rdp_kind": kind}
    end = rest.find(b"\r\n")
    if end >= 0 and rest.startswith(b"Cookie: "):
        cookie = rest[8:end].decode("latin-1")
        out["rdp_user"] = cookie[9:] if cookie.startswith("mstshash=") else None
        rest = rest[end + 2 :]
    if len(rest) >= 8 and rest[0] in (1, 2):
        out["rdp_protocols"] = int.from_bytes(rest[4:8], "little")
    return out


def rdp(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Remote desktop connections (port 3389): request or confirm, the user's cookie, the security protocols asked for or chosen."""
    m = streams.messages(_on(packets, 6, 3389), _first_unit, "payload binary", by, head=streams.HEAD)
    return parsed(m, rdp_message, "rdp_kind string, rdp_user string, rdp_protocols long")


def windows(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """File sharing, Kerberos, directory and remote desktop messages in one table: what ``triage.lateral_movement`` reads."""
    all_ = [f(packets, by) for f in (smb, kerberos, ldap, rdp)]
    out = all_[0]
    for m in all_[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


# Management and control.


def snmp_message(data: bytes) -> dict | None:
    parts = elements(data, *element(data, 0)[1:])
    version = _int(data, parts[0][1:])
    if version in (0, 1) and len(parts) >= 3 and parts[2][0] & 0xE0 == 0xA0:
        return {"snmp_version": "1" if version == 0 else "2c", "snmp_community": _text(data, parts[1][1:]), "snmp_op": SNMP[parts[2][0] & 31]}
    return {"snmp_version": "3"} if version == 3 else None


#: Operations of network management, of access requests, and of trivial file transfer.
SNMP = ["get", "get_next", "response", "set", "trap", "get_bulk", "inform", "trap2", "report"]
RADIUS = {1: "access_request", 2: "access_accept", 3: "access_reject", 4: "accounting_request", 5: "accounting_response", 11: "access_challenge"}
TFTP = {1: "read", 2: "write", 3: "data", 4: "ack", 5: "error"}


def snmp(packets: DataFrame) -> DataFrame:
    """Network management over UDP (161, 162): version, community and operation."""
    return parsed(_on(packets, 17, 161, 162), snmp_message, "snmp_version string, snmp_community string, snmp_op string")


def radius_message(data: bytes) -> dict | None:
    code, ident, size = struct.unpack_from(">BBH", data)
    if code not in RADIUS or not 20 <= size <= len(data):
        return None
    out, at = {"radius_kind": RADIUS[code], "radius_id": ident}, 20
    while at + 2 <= size and data[at + 1] >= 2:
        value = data[at + 2 : at + data[at + 1]]
        field = {1: "radius_user", 31: "radius_station", 32: "radius_server"}.get(data[at])
        if field:
            out[field] = value.decode("utf-8", "replace")
        at += data[at + 1]
    return out


def radius(packets: DataFrame) -> DataFrame:
    """Access and accounting over UDP (1812, 1813, 1645, 1646): kind, id, user, calling station and server."""
    return parsed(_on(packets, 17, 1812, 1813, 1645, 1646), radius_message, "radius_kind string, radius_id long, radius_user string, radius_station string, radius_server string")


def tftp(packets: DataFrame) -> DataFrame:
    """Trivial file transfer's requests over UDP (69): operation, file and mode."""
    text = F.decode(F.substring("payload", 3, 1 << 16), "ISO-8859-1")
    p = _on(packets, 17, 69).filter(number(F.col("payload"), 0, 2).isin(1, 2))
    part = lambda k: F.get(F.split(text, "\0"), F.lit(k))
    return p.withColumns({"tftp_op": F.when(number(F.col("payload"), 0, 2) == 1, "read").otherwise("write"), "tftp_file": part(0), "tftp_mode": F.lower(part(1))})


def modbus(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Modbus over TCP (502): by, conn, nth, ts_us, transaction, unit, function (less the error bit), and the exception's code."""

    def units() -> streams.Reader:
        def read(data: bytes) -> tuple[int, list[tuple], bool]:
            at, found = 0, []
            while at + 7 <= len(data):
                number_, protocol, size = struct.unpack_from(">HHH", data, at)
                if protocol or not 2 <= size <= 260:
                    return at, found, False
                if at + 6 + size > len(data):
                    break
                function = data[at + 7]
                found.append((number_, data[at + 6], function & 127, data[at + 8] if function & 128 and size > 2 else None))
                at += 6 + size
            return at, found, True

        return read

    return streams.messages(_on(packets, 6, 502), units, "modbus_id long, modbus_unit long, modbus_function long, modbus_exception long", by)


def lines(most: int = 8192) -> Callable[[], streams.Reader]:
    """Lines, without their ends."""

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while (end := data.find(b"\n", at)) >= 0:
            found.append((data[at:end].rstrip(b"\r").decode("utf-8", "replace"),))
            at = end + 1
        return at, found, len(data) - at <= most

    return lambda: read


def commands(packets: DataFrame, *ports: int, by: list[str] | None = None) -> DataFrame:
    """Lines of command protocols over TCP (21: file transfer, 25 and 587: mail): by, conn, nth, ts_us, line, the command or reply code, and what follows it. The body of a mail goes by as lines too."""
    m = streams.messages(_on(packets, 6, *(ports or (21, 25, 587))), lines(), "line string", by)
    code = F.regexp_extract("line", r"^(\d{3})(?:[ -]|$)", 1)
    verb = F.upper(F.regexp_extract("line", r"^([A-Za-z]{3,12})(?:[ :]|$)", 1))
    return m.withColumns({"reply": F.nullif(code, F.lit("")).cast("int"), "command": F.nullif(verb, F.lit("")), "argument": F.nullif(F.trim(F.regexp_extract("line", r"^\S+[ -](.*)$", 1)), F.lit(""))})


def ssdp(packets: DataFrame) -> DataFrame:
    """Service discovery over UDP (1900): method or answer, target, location, server."""
    text = F.decode("payload", "ISO-8859-1")
    get = lambda name: F.nullif(F.regexp_extract(text, rf"(?i)\r\n{name}: *([^\r\n]*)", 1), F.lit(""))
    p = _on(packets, 17, 1900).withColumn("ssdp_kind", F.nullif(F.regexp_extract(text, r"^(M-SEARCH|NOTIFY|HTTP/1\.1 200)", 1), F.lit(""))).filter("ssdp_kind IS NOT NULL")
    return p.withColumns({"ssdp_target": F.coalesce(get("ST"), get("NT")), "ssdp_location": get("LOCATION"), "ssdp_server": get("SERVER")})


def netbios_names(packets: DataFrame) -> DataFrame:
    """Name service of NetBIOS over UDP (137): id, whether an answer, the name and its suffix."""

    def read(data: bytes) -> dict | None:
        ident, flags, asked, told = struct.unpack_from(">HHHH", data)
        coded = data[13:45]
        if data[12] != 32 or not (asked or told) or len(coded) < 32:
            return None
        name = bytes(((coded[i] - 65) << 4 | coded[i + 1] - 65) & 255 for i in range(0, 32, 2))
        return {"nbns_id": ident, "nbns_answer": flags >> 15, "nbns_name": name[:15].decode("latin-1").rstrip(), "nbns_suffix": name[15]}

    return parsed(_on(packets, 17, 137), read, "nbns_id long, nbns_answer long, nbns_name string, nbns_suffix long")


def dnp3(packets: DataFrame) -> DataFrame:
    """Data link frames of DNP3 at the start of payloads (20000): destination, source, function of the link, and of the application where it is there."""
    body = F.col("payload")
    little = lambda at: number(body, at, 1) + number(body, at + 1, 1) * 256
    p = packets.filter("(proto = 6 OR proto = 17) AND (src_port = 20000 OR dst_port = 20000)").filter((F.hex(F.substring(body, 1, 2)) == "0564") & (F.length(body) >= 10))
    return p.withColumns({"dnp3_link": number(body, 3, 1).bitwiseAND(F.lit(15)), "dnp3_dst": little(4), "dnp3_src": little(6), "dnp3_function": F.when(F.length(body) >= 13, number(body, 12, 1))})


#: Applications by the first protocol that a hello names, and by ends of server names.
BY_ALPN = {"h2": "http2", "http/1.1": "http", "h3": "http3", "dot": "dot", "doq": "doq", "imap": "imap", "pop3": "pop3", "xmpp-client": "xmpp", "mqtt": "mqtt", "ftp": "ftp", "smb": "smb", "ntske/1": "nts", "acme-tls/1": "acme", "stun.turn": "turn", "webrtc": "webrtc"}


def application(rows: DataFrame, names: dict[str, str] | None = None, port: str = "dst_port", sni: str = "sni", alpn: str = "alpn") -> DataFrame:
    """rows with ``app``: by the server's name (``names``: suffix to application, the longest that holds), then by the protocol that the hello names, then a resolver over HTTPS by its name, then by port."""
    there = set(rows.columns)
    steps = []
    if sni in there:
        for suffix, app in sorted((names or {}).items(), key=lambda x: -len(x[0])):
            bare = net.bare_name(F.col(sni))
            steps.append(F.when((bare == suffix) | bare.endswith("." + suffix), F.lit(app)))
        steps.append(F.when(net.is_doh_resolver(F.col(sni)), F.lit("doh")))
    if alpn in there:
        steps.append(F.try_element_at(F.create_map(*(F.lit(x) for kv in BY_ALPN.items() for x in kv)), F.lower(F.col(alpn))))
    if port in there:
        steps.append(app_label(F.col(port)))
    return rows.withColumn("app", F.coalesce(*steps) if steps else F.lit(None).cast("string"))
