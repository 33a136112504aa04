"""Flows as messages of the flow export standard, in bytes, with template sets and sequence numbers, made by no single task.

A record's place in the sequence follows from its second of export and a share of it: records are counted by both, the counts are summed up over
seconds and over a second's shares, and within a share rows are numbered. So only counts, one a second, ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from .formats import END_REASONS, _code

#: The standard's version, the set that templates are in, and our templates' numbers by family.
VERSION, TEMPLATES, FOUR, SIX = 10, 2, 256, 257
#: Information elements of a record in order: number and bytes; addresses are those of the family.
ELEMENTS = ((4, 1), (7, 2), (11, 2), (None, None), (None, None), (1, 8), (2, 8), (85, 8), (86, 8), (152, 8), (153, 8), (6, 2), (136, 1))
ADDRESSES = {FOUR: ((8, 4), (12, 4)), SIX: ((27, 16), (28, 16))}


def _be(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def template(number: int) -> bytes:
    """A template record."""
    addresses = iter(ADDRESSES[number])
    fields = [next(addresses) if e is None else (e, size) for e, size in ELEMENTS]
    return number.to_bytes(2, "big") + len(fields).to_bytes(2, "big") + b"".join(e.to_bytes(2, "big") + size.to_bytes(2, "big") for e, size in fields)


def template_set() -> bytes:
    body = template(FOUR) + template(SIX)
    return TEMPLATES.to_bytes(2, "big") + (4 + len(body)).to_bytes(2, "big") + body


def encoded(f: DataFrame) -> DataFrame:
    """Flows with ``template`` and ``record``: the initiator is the source, deltas are its own, totals are both sides'. Ends without a port have 0."""
    six = "a_ip6" in f.columns
    own = F.col("a_initiated")
    ends = {x: net.ip_octets(F.col(f"{x}_ip4"), F.col(f"{x}_ip6") if six else None) for x in "ab"}
    pick = lambda a, b: F.when(own, a).otherwise(b)
    port = lambda x: F.coalesce(F.col(f"{x}_port"), F.lit(0))
    total = lambda x: F.col(f"{x}_initiator") + F.col(f"{x}_responder")
    flags = F.col("flags") if "flags" in f.columns else F.lit(0)
    millis = lambda c: F.floor(F.col(c) / 1000)
    parts = [
        _be(F.col("proto"), 1), _be(pick(port("a"), port("b")), 2), _be(pick(port("b"), port("a")), 2), pick(ends["a"], ends["b"]), pick(ends["b"], ends["a"]), _be(F.col("bytes_initiator"), 8),
        _be(F.col("packets_initiator"), 8), _be(total("bytes"), 8), _be(total("packets"), 8), _be(millis("start_us"), 8), _be(millis("end_us"), 8), _be(flags, 2), _be(F.coalesce(_code(F.col("reason"), END_REASONS), F.lit(2)), 1),
    ]
    return f.withColumns({"template": F.when(F.length(ends["a"]) == 4, FOUR).otherwise(SIX), "record": F.concat(*parts)})


def messages(f: DataFrame, domain: int = 0, per_message: int = 16, resend_every: int = 0, shares: int = 64) -> DataFrame:
    """number (from 0), sequence (records before it, modulo 2^32), export_s, n_records, message: flows as messages of up to so many records.

    Records go by second of their end, then by share (their begin modulo ``shares``), then in order of time and bytes. The first message, and every
    ``resend_every``-th after it (0: no other), begins with the templates. Flows with the same bytes are records of their own.
    """
    second = F.floor(F.col("end_us") / 1_000_000)
    r = encoded(f).select(second.alias("second"), F.pmod(F.col("start_us"), F.lit(shares)).alias("share"), "end_us", "template", "record")
    w = Window.partitionBy("second", "share").orderBy("end_us", "record")
    r = r.withColumn("at", F.row_number().over(w) - 1).withColumn("part", F.floor(F.col("at") / per_message))
    counts = r.groupBy("second", "share").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("m", F.ceil(F.col("n") / per_message))
    seconds = counts.groupBy("second").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    before = Window.orderBy("second").rowsBetween(Window.unboundedPreceding, -1)  # a row a second
    seconds = seconds.select("second", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "nm"))
    inside = Window.partitionBy("second").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select("second", "share", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_inside") for c in "nm")).join(seconds, "second")
    places = places.select("second", "share", (F.col("n_before") + F.col("n_inside")).alias("first"), (F.col("m_before") + F.col("m_inside")).alias("first_m"))
    held = r.groupBy("second", "share", "part").agg(F.array_sort(F.collect_list(F.struct("at", "template", "record"))).alias("rows"))
    held = held.join(places, ["second", "share"])
    number = F.col("first_m") + F.col("part")
    sequence = F.pmod(F.col("first") + F.col("part") * per_message, F.lit(1 << 32))

    def data_set(kind: int) -> Column:
        rows = F.filter("rows", lambda x: x["template"] == kind)
        body = F.aggregate(rows, F.lit(b""), lambda a, x: F.concat(a, x["record"]))
        return F.when(F.size(rows) > 0, F.concat(_be(F.lit(kind), 2), _be(F.length(body) + 4, 2), body)).otherwise(F.lit(b""))

    again = F.pmod(number, F.lit(resend_every)) == 0 if resend_every else number == 0
    sets = F.concat(F.when(again, F.lit(template_set())).otherwise(F.lit(b"")), data_set(FOUR), data_set(SIX))
    held = held.select(number.alias("number"), sequence.alias("sequence"), F.col("second").alias("export_s"), F.size("rows").cast("long").alias("n_records"), sets.alias("sets"))
    head = F.concat(_be(F.lit(VERSION), 2), _be(F.length("sets") + 16, 2), _be(F.col("export_s"), 4), _be(F.col("sequence"), 4), _be(F.lit(domain), 4))
    return held.withColumn("message", F.concat(head, F.col("sets"))).drop("sets")
