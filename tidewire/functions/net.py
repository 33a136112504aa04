"""Scalar functions on network data: addresses, names, hashes, classes. All are Spark columns."""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IANA protocol numbers.
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp", 58: "icmp6", 132: "sctp"}
#: Host names of public resolvers that speak DNS over HTTPS.
DOH_HOSTS = (
    "cloudflare-dns.com", "mozilla.cloudflare-dns.com", "one.one.one.one", "dns.google", "dns.google.com", "dns.quad9.net",
    "doh.opendns.com", "dns.adguard.com", "dns.adguard-dns.com", "doh.cleanbrowsing.org", "dns.nextdns.io", "doh.mullvad.net",
)
#: Fixed value: the key of the published Toeplitz test vectors for receive-side scaling.
RSS_KEY = bytes.fromhex("6d5a56da255b0ec24167253d43a38fb0d0ca2bcbae7b30b477cb2da38030f20c6a42b73bbeac01fa")


def _names(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0.0 where b is 0 or either is null."""
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def ip4_text(ip4: Column) -> Column:
    return F.when(ip4.isNotNull(), _dotted(ip4))


def _dotted(ip4: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(ip4, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)))


def ip4_number(text: Column) -> Column:
    """Null if text is no dotted IPv4 address."""
    parts = F.split(text, r"\.")
    number = sum((F.get(parts, i).cast("long") * F.lit(1 << s) for i, s in enumerate((24, 16, 8, 0))), F.lit(0).cast("long"))
    octet = r"(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.when(text.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def cidr_range(net: str) -> tuple[int, int]:
    """First and last address of an IPv4 net; host bits are masked."""
    n = ipaddress.IPv4Network(net, strict=False)
    return int(n.network_address), int(n.broadcast_address)


def in_cidr(ip4: Column, net: str) -> Column:
    low, high = cidr_range(net)
    return ip4.between(low, high)


def glob(column: Column, pattern: str) -> Column:
    """Whole-string match, ``*`` for any run of characters, ASCII case ignored. Plain prefixes and suffixes can reach the scan."""
    low, p = F.lower(column), pattern.lower()
    body = p.strip("*")
    if "*" not in body:
        if p == body:
            return low == body
        if p == body + "*":
            return low.startswith(body)
        if p == "*" + body:
            return low.endswith(body)
    return low.rlike("(?s)^" + ".*".join(re.escape(x) for x in p.split("*")) + "$")


def bare_name(name: Column) -> Column:
    """A domain name in lower case without its trailing dot."""
    return F.regexp_replace(F.lower(name), r"\.$", "")


def second_level(name: Column) -> Column:
    """The label before the last one; null where there is none."""
    parts = F.split(bare_name(name), r"\.")
    return F.get(parts, F.size(parts) - 2)


def label_suffixes(name: Column) -> Column:
    """The name and all of its parent domains, longest first."""
    parts = F.split(bare_name(name), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def is_doh_resolver(name: Column) -> Column:
    return F.coalesce(bare_name(name).isin(*DOH_HOSTS), F.lit(False))


def proto_label(proto: Column) -> Column:
    return F.coalesce(F.try_element_at(_names(PROTOCOLS), proto.cast("int")), F.concat(F.lit("proto-"), proto.cast("string")))


def rcode_class(rcode: Column) -> Column:
    return F.when(rcode == 0, "ok").when(rcode == 3, "nxdomain").when(rcode == 2, "servfail").when(rcode == 5, "refused").otherwise("other")


def flow_class(reason: Column) -> Column:
    return F.when(reason == "rst", "reset").when(reason == "parse_error", "parse_error").otherwise("clean")


def icmp_kind(type_: Column, code: Column) -> Column:
    """Slug of an ICMPv4 error; null for other messages, redirects among them."""
    unreachable = F.when(code == 0, "net_unreachable").when(code == 1, "host_unreachable").when(code == 3, "port_unreachable").when(code == 4, "fragmentation_needed").when(code.isin(9, 10, 13), "admin_prohibited").otherwise("unreachable")
    return F.when(type_ == 3, unreachable).when(type_ == 11, "time_exceeded").when(type_ == 12, "parameter_problem")


def icmp6_kind(type_: Column, code: Column) -> Column:
    """Slug of an ICMPv6 error; null for other messages."""
    unreachable = F.when(code == 0, "net_unreachable").when(code == 3, "host_unreachable").when(code == 4, "port_unreachable").when(code.isin(1, 5, 6), "admin_prohibited").otherwise("unreachable")
    return F.when(type_ == 1, unreachable).when(type_ == 2, "fragmentation_needed").when(type_ == 3, "time_exceeded").when(type_ == 4, "parameter_problem")


def ip6_bytes(text: Column) -> Column:
    """The 16 bytes of an IPv6 address in any of its spellings, a dotted tail included; null if text is none."""
    tail = F.regexp_extract(text, r":([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    four = F.lpad(F.hex(ip4_number(tail)), 8, "0")
    plain = F.when(tail == "", text).otherwise(F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.substring(four, 1, 4), F.lit(":"), F.substring(four, 5, 4)))
    halves = F.split(plain, "::", -1)
    groups = lambda half: F.transform(F.filter(F.split(half, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    head, rest = groups(F.get(halves, 0)), F.coalesce(groups(F.get(halves, 1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0000"), F.lit(8) - F.size(head) - F.size(rest))
    whole = F.array_join(F.concat(head, zeros, rest), "")
    good = plain.rlike(r"^[0-9A-Fa-f:]+$") & ~plain.rlike(r":::|[0-9A-Fa-f]{5}|^:[^:]|[^:]:$") & F.when(F.size(halves) == 2, F.size(head) + F.size(rest) < 8).otherwise((F.size(halves) == 1) & (F.size(head) == 8))
    return F.when(good & (F.length(whole) == 32), F.unhex(whole))


def ip6_text(ip6: Column) -> Column:
    """An IPv6 address of 16 bytes in its canonical spelling: lower case, the first longest run of zero groups shortened."""
    plain = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(F.lower(F.hex(F.substring(ip6, i * 2 + 1, F.lit(2)))), "^0{1,3}", "")), ":")
    short = plain
    for n in range(2, 9):  # the longest run is the last to win
        run = ":".join("0" * n)
        short = F.when(plain.rlike(rf"(^|:){run}(:|$)"), F.regexp_replace(F.concat(F.regexp_extract(plain, rf"^(.*?)(?:^|:){run}(?=:|$)", 1), F.lit("::"), F.regexp_extract(plain, rf"^.*?(?:^|:){run}(?::|$)(.*)$", 1)), ":::", "::")).otherwise(short)
    return F.when(F.length(ip6) == 16, short)


def in_cidr6(ip6: Column, net: str) -> Column:
    """Whether an address of 16 bytes lies in an IPv6 net; host bits of the net are masked."""
    n = ipaddress.IPv6Network(net, strict=False)
    return ip6.between(F.lit(n.network_address.packed), F.lit(n.broadcast_address.packed))


def ip_text(ip4: Column, ip6: Column | None = None) -> Column:
    """The text of an end that has an IPv4 address as a number or an IPv6 address of 16 bytes; null if it has neither."""
    return ip4_text(ip4) if ip6 is None else F.coalesce(ip4_text(ip4), ip6_text(ip6))


def ip_octets(ip4: Column, ip6: Column | None = None) -> Column:
    """The 4 or 16 bytes of such an end."""
    four = F.when(ip4.isNotNull(), _octets(ip4, 4))
    return four if ip6 is None else F.coalesce(four, ip6)


def unit_interval(h: Column) -> Column:
    """A 64-bit hash as a double in [0, 1)."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0.0 for an empty text.

    A text is an array of characters, sorted; runs of equal ones are counted by where they end.
    """
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    n = F.size(chars)
    none = F.struct(F.lit("").alias("c"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    term = lambda run: F.when(run > 0, run * F.log2(run.cast("double"))).otherwise(0.0)

    def add(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["run"] + 1).otherwise(1).alias("run"), (a["sum"] + F.when(same, 0.0).otherwise(term(a["run"]))).alias("sum"))

    total = F.aggregate(chars, none, add, lambda a: a["sum"] + term(a["run"]))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def _octets(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def community_id(proto: Column, ip_a: Column, port_a: Column, ip_b: Column, port_b: Column, seed: int = 0) -> Column:
    """Version 1 of the public community id for flows whose ends are IPv4 addresses as numbers; ``community_id_of`` takes their bytes."""
    return community_id_of(proto, _octets(ip_a, 4), port_a, _octets(ip_b, 4), port_b, seed)


def community_id_of(proto: Column, a: Column, port_a: Column, b: Column, port_b: Column, seed: int = 0) -> Column:
    """Version 1 of the public community id for flows between addresses of 4 or 16 bytes."""
    first = (a < b) | ((a == b) & (port_a <= port_b))
    pick = lambda yes, no: F.when(first, yes).otherwise(no)
    raw = F.concat(F.lit(seed.to_bytes(2, "big")), pick(a, b), pick(b, a), _octets(proto, 1), F.lit(b"\0"), _octets(pick(port_a, port_b), 2), _octets(pick(port_b, port_a), 2))
    return F.concat(F.lit("1:"), F.base64(F.unhex(F.sha1(raw))))


#: A key whose 16-bit words are all the same: both ways of a flow get one hash.
SYMMETRIC_KEY = bytes.fromhex("6d5a" * 20)


def rss_hash6(src_ip6: Column, dst_ip6: Column, src_port: Column | None = None, dst_port: Column | None = None, key: bytes = RSS_KEY) -> Column:
    """The Toeplitz hash of a pair of IPv6 addresses of 16 bytes, with ports if given."""
    word = lambda ip, k: F.conv(F.hex(F.substring(ip, 4 * k + 1, 4)), 16, 10).cast("long")
    fields = [(word(ip, k), 32) for ip in (src_ip6, dst_ip6) for k in range(4)]
    return _toeplitz(fields + ([(src_port, 16), (dst_port, 16)] if src_port is not None else []), key)


def rss_hash(src_ip4: Column, dst_ip4: Column, src_port: Column | None = None, dst_port: Column | None = None, key: bytes = RSS_KEY) -> Column:
    """Toeplitz hash of an IPv4 pair, with ports if given. With ``SYMMETRIC_KEY`` both ways of a flow have the same."""
    return _toeplitz([(src_ip4, 32), (dst_ip4, 32)] + ([(src_port, 16), (dst_port, 16)] if src_port is not None else []), key)


def _toeplitz(fields: list[tuple[Column, int]], key: bytes) -> Column:
    """The key's 32-bit windows at all set bits, XORed."""
    bits = int.from_bytes(key, "big")
    window = lambda i: (bits >> (8 * len(key) - 32 - i)) & 0xFFFFFFFF
    out, at = F.lit(0).cast("long"), 0
    for column, width in fields:
        windows = F.array(*(F.lit(window(at + i)).cast("long") for i in range(width)))
        wide = column.cast("long")
        here = F.aggregate(F.zip_with(windows, F.sequence(F.lit(width - 1), F.lit(0), F.lit(-1)), lambda w, s: w * F.call_function("shiftright", wide, s).bitwiseAND(F.lit(1).cast("long"))), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))
        out, at = out.bitwiseXOR(here), at + width
    return out


def ja3(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    """md5 of the five client-hello fields; reserved filler values (0x?a?a) are left out."""
    real = lambda a: F.array_join(F.transform(F.filter(a, lambda x: ~((x.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(F.lit(255))))), lambda x: x.cast("string")), "-")
    return F.md5(F.concat_ws(",", version.cast("string"), real(ciphers), real(extensions), real(curves), F.array_join(F.transform(formats, lambda x: x.cast("string")), "-")))


def _filler(x: Column) -> Column:
    """Whether a number is one of the reserved filler values (0x?a?a)."""
    return (x.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & (F.shiftright(x, 8) == x.bitwiseAND(F.lit(255)))


def ja4(version: Column, versions: Column, ciphers: Column, extensions: Column, signatures: Column, alpn: Column, transport: str = "t") -> Column:
    """The published JA4 fingerprint of a client hello over TCP (``transport`` t) or QUIC (q): counts in the open, then hashes of the sorted ciphers and extensions."""
    real = lambda a: F.filter(F.coalesce(a, F.array().cast("array<int>")), lambda x: ~_filler(x))
    code = lambda x: F.lower(F.lpad(F.hex(x), 4, "0"))
    listed = lambda a: F.array_join(F.transform(a, code), ",")
    count = lambda a: F.lpad(F.least(F.size(a), F.lit(99)).cast("string"), 2, "0")
    digest = lambda a, text: F.when(F.size(a) == 0, "0" * 12).otherwise(F.substring(F.sha2(text, 256), 1, 12))
    best = F.coalesce(F.array_max(real(versions)), version)
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in {0x0304: "13", 0x0303: "12", 0x0302: "11", 0x0301: "10", 0x0300: "s3"}.items() for x in kv)), best.cast("int")), F.lit("00"))
    plain = F.concat(F.substring(alpn, 1, 1), F.substring(alpn, -1, 1))
    coded = F.lower(F.hex(F.encode(alpn, "UTF-8")))
    offer = F.when(F.coalesce(alpn, F.lit("")) == "", "00").when(plain.rlike("^[0-9A-Za-z]{2}$"), plain).otherwise(F.concat(F.substring(coded, 1, 1), F.substring(coded, -1, 1)))
    exts, sign = real(extensions), real(signatures)
    hashed = listed(F.array_sort(F.filter(exts, lambda x: ~x.isin(0, 16))))
    hashed = F.when(F.size(sign) > 0, F.concat(hashed, F.lit("_"), listed(sign))).otherwise(hashed)
    head = F.concat(F.lit(transport), named, F.when(F.array_contains(exts, 0), "d").otherwise("i"), count(real(ciphers)), count(exts), offer)
    return F.concat_ws("_", head, digest(real(ciphers), listed(F.array_sort(real(ciphers)))), digest(exts, hashed))


def hassh(kex: Column, ciphers: Column, macs: Column, compressions: Column) -> Column:
    return F.md5(F.concat_ws(";", *(F.array_join(a, ",") for a in (kex, ciphers, macs, compressions))))


def file_type(body: Column) -> Column:
    """By magic bytes; null if unknown."""
    head = F.hex(F.substring(body, 1, 8))
    return F.when(head.startswith("4D5A"), "exe").when(head.startswith("7F454C46"), "elf").when(head.startswith("25504446"), "pdf").when(head.startswith("504B0304"), "zip").when(head.startswith("89504E47"), "png").when(head.startswith("1F8B"), "gzip")
