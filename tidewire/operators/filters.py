"""Packet, flow and session filters as columns.

Atoms take no text to parse: they are built, and joined by ``&``, ``|`` and ``~``; filters kept as
text are Spark SQL conditions (``where``). All logic is two-valued: an atom on an absent field is
false, so its negation is true, and every atom is made so before it is negated. Equality atoms and
plain globs reach the scan as pushed filters.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import net

ETHERTYPES = {"ipv4": 0x0800, "arp": 0x0806, "ipv6": 0x86DD}


@dataclass(frozen=True, eq=False)
class Predicate:
    """A condition with its readable form; its column is made when there is a session to make it in."""

    make: Callable[[], Column]
    text: str

    @property
    def column(self) -> Column:
        return self.make()

    def __and__(self, other: Predicate) -> Predicate:
        if self is ANY or other is ANY:
            return other if self is ANY else self
        return Predicate(lambda: self.column & other.column, f"{self._inner()} and {other._inner()}")

    def __or__(self, other: Predicate) -> Predicate:
        if self is ANY or other is ANY:
            return ANY
        return Predicate(lambda: self.column | other.column, f"{self._inner()} or {other._inner()}")

    def __invert__(self) -> Predicate:
        return Predicate(lambda: ~self.column, f"not ({self.text})" if " " in self.text else f"not {self.text}")

    def _inner(self) -> str:
        return f"({self.text})" if " or " in self.text else self.text


#: Holds for every row: neutral to ``&``, absorbing for ``|``.
ANY = Predicate(lambda: F.lit(True), "")


def _atom(make: Callable[[], Column], text: str) -> Predicate:
    return Predicate(lambda: F.coalesce(make(), F.lit(False)), text)


def proto(number: int) -> Predicate:
    return _atom(lambda: F.col("proto") == number, net.PROTOCOLS.get(number, f"proto {number}"))


tcp, udp, icmp = proto(6), proto(17), proto(1)


def _sides(side: str, make, text: str) -> Predicate:
    """side: src, dst or any, which is either of the two."""
    if side not in ("src", "dst", "any"):
        raise ValueError(f"side must be src, dst or any, not {side}")
    if side == "any":
        return _atom(lambda: F.coalesce(make("src"), F.lit(False)) | F.coalesce(make("dst"), F.lit(False)), text)
    return _atom(lambda: make(side), f"{side} {text}")


def port(number: int, side: str = "any") -> Predicate:
    if not 0 <= number <= 65535:
        raise ValueError("a port has 16 bits")
    return _sides(side, lambda s: F.col(f"{s}_port") == number, f"port {number}")


def ports(numbers: Iterable[int], side: str = "any") -> Predicate:
    numbers = sorted(set(numbers))
    if not numbers:
        raise ValueError("no ports")
    return _sides(side, lambda s: F.col(f"{s}_port").isin(*numbers), "port in " + ",".join(map(str, numbers)))


def host(address: str, side: str = "any") -> Predicate:
    """An IPv4 address over ``*_ip4``, or an IPv6 one over ``*_ip6``."""
    if ":" in address:
        six = ipaddress.IPv6Address(address).packed
        return _sides(side, lambda s: F.col(f"{s}_ip6") == F.lit(six), f"host {address}")
    low, _ = net.cidr_range(address)
    return _sides(side, lambda s: F.col(f"{s}_ip4") == low, f"host {address}")


def network(cidr: str, side: str = "any") -> Predicate:
    if ":" in cidr:
        return _sides(side, lambda s: net.in_cidr6(F.col(f"{s}_ip6"), cidr), f"net {cidr}")
    return _sides(side, lambda s: net.in_cidr(F.col(f"{s}_ip4"), cidr), f"net {cidr}")


def vlan(number: int) -> Predicate:
    return _atom(lambda: F.col("vlan_id") == number, f"vlan {number}")


def ethertype(number: int) -> Predicate:
    return _atom(lambda: F.col("ethertype") == number, f"ethertype 0x{number:04x}")


def more_than(field: str, n: int) -> Predicate:
    """Strictly more bytes or packets, or whatever column of flows."""
    return _atom(lambda: F.col(field) > n, f"{field} > {n}")


def matches(field: str, pattern: str) -> Predicate:
    """A glob on a session's name: sni, http_host, dns_qname."""
    return _atom(lambda: net.glob(F.col(field), pattern), f"{field} ~ {pattern}")


def where(condition: str) -> Predicate:
    """A Spark SQL condition over the table's columns; blank means every row."""
    return _atom(lambda: F.expr(condition), condition) if condition.strip() else ANY


def all_of(*parts: Predicate) -> Predicate:
    """A chain of conditions, checked for conflicts that no row could meet."""
    fixed = [p.text for p in parts if p.text in ("tcp", "udp", "icmp")]
    if len(set(fixed)) > 1:
        raise ValueError(f"no packet is {' and '.join(sorted(set(fixed)))} at once")
    out, seen = ANY, set()
    for p in parts:
        if p.text not in seen:
            out, seen = out & p, seen | {p.text}
    return out


def select(rows: DataFrame, predicate: Predicate) -> DataFrame:
    return rows if predicate is ANY else rows.filter(predicate.column)
