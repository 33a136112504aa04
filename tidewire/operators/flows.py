"""Flows from packets: canonical keys, sessions by idle time and end flags, records, conversations, reassembly."""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import net
from . import folds

KEY = ["proto", "a_ip4", "a_port", "b_ip4", "b_port"]
#: Idle time a protocol, in microseconds. The values are ours; pass others as needed.
IDLE_US = {6: 300_000_000, 17: 60_000_000}
OTHER_IDLE_US = 30_000_000
#: Bits of the TCP flags.
FIN, SYN, RST, ACK = 1, 2, 4, 16


def key_of(table: DataFrame) -> list[str]:
    """The columns of a flow's key: with a_ip6 and b_ip6 where the packets or flows have IPv6 addresses."""
    six = {"src_ip6", "a_ip6"} & set(table.columns)
    return [*KEY, "a_ip6", "b_ip6"] if six else KEY


def with_key(packets: DataFrame, directional: bool = False) -> DataFrame:
    """Packets of known ends with their 5-tuple and ``forward``: sent by a. The lesser end is a; ``directional``: always the sender.

    An end is an IPv4 address as a number (``*_ip4``) or, where there are such columns, an IPv6 address of
    16 bytes (``*_ip6``), and a port or null. Packets without an address at either end belong to no flow.
    """
    some = [f"ip{n}" for n in (4, 6) if f"src_ip{n}" in packets.columns]
    order = lambda x: F.struct(*(F.coalesce(F.col(f"{x}_{c}"), F.lit(b"" if c == "ip6" else -1)) for c in (*some, "port")))
    forward = F.lit(True) if directional else order("src") <= order("dst")
    pick = lambda yes, no: F.when(forward, F.col(yes)).otherwise(F.col(no))
    ends = {f"{end}_{c}": pick(f"{yes}_{c}", f"{no}_{c}") for end, yes, no in (("a", "src", "dst"), ("b", "dst", "src")) for c in (*some, "port")}
    known = lambda x: F.coalesce(*(F.col(f"{x}_{c}").cast("string") for c in some)).isNotNull()
    return packets.filter(known("src") & known("dst")).withColumns(ends | {"forward": forward})


def idle_time(proto: Column, idle_us: dict[int, int] | None = None, other_us: int = OTHER_IDLE_US) -> Column:
    out = None
    for number, us in (IDLE_US if idle_us is None else idle_us).items():
        out = (F if out is None else out).when(proto == number, F.lit(us))
    return (F.lit(other_us) if out is None else out.otherwise(F.lit(other_us))).cast("long")


_SUMS = {
    "start_us": lambda: F.min("start_us"),
    "end_us": lambda: F.max("end_us"),
    "packets_a": lambda: F.sum("packets_a"),
    "packets_b": lambda: F.sum("packets_b"),
    "bytes_a": lambda: F.sum("bytes_a"),
    "bytes_b": lambda: F.sum("bytes_b"),
    "first": lambda: F.min("first"),
    "flags": lambda: F.bit_or("flags"),
}


def _partial(packets: DataFrame, by: list[str], more: dict[str, Column] | None = None) -> DataFrame:
    one = F.lit(1).cast("long")
    flags = F.col("tcp_flags") if "tcp_flags" in packets.columns else F.lit(0)
    sums = {  # of the packets' own columns, so that what is sorted for the sums has no others
        "start_us": F.min("ts_us"), "end_us": F.max("ts_us"),
        "packets_a": F.sum(F.when(F.col("forward"), one).otherwise(0)), "packets_b": F.sum(F.when(F.col("forward"), 0).otherwise(one)),
        "bytes_a": F.sum(F.when(F.col("forward"), F.col("len")).otherwise(0)), "bytes_b": F.sum(F.when(F.col("forward"), 0).otherwise(F.col("len"))),
        "first": F.min(F.struct("ts_us", "seq", "forward")), "flags": F.bit_or(flags.cast("int")),
    }
    return packets.groupBy(*by).agg(*(c.alias(n) for n, c in (sums | (more or {})).items()))


def _numbered(p: DataFrame) -> DataFrame:
    """Sums of packets (with key, idle_us) by key and stretch of idle time, with the number ``nth`` of the flow that the stretch is in."""
    key = key_of(p)
    stretch = _partial(p.withColumn("stretch", F.floor(F.col("ts_us") / F.col("idle_us"))), [*key, "idle_us", "stretch"])
    w = Window.partitionBy(*key).orderBy("stretch")
    new = F.coalesce(F.col("start_us") - F.lag("end_us").over(w) > F.col("idle_us"), F.lit(True))
    return stretch.withColumn("nth", F.sum(new.cast("int")).over(w))


#: How long after a connection has closed its late packets still count as its own, in microseconds.
LINGER_US = 60_000_000


def _bits(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def _flags(p: DataFrame) -> Column:
    return F.when(F.col("proto") == 6, F.coalesce(F.col("tcp_flags"), F.lit(0))).otherwise(0).cast("int")


def _runs(p: DataFrame, linger_us: int) -> DataFrame:
    """Packets with ``bucket_`` and ``run_``: within a stretch of time no longer than any silence that ends a flow, a SYN, FIN or RST and
    what follows it up to the next. Flows can only begin where runs begin, so runs are summed before anything is put in order by key alone.
    """
    width = F.when(F.col("proto") == 6, F.least(F.col("idle_us"), F.lit(linger_us))).otherwise(F.col("idle_us"))
    p = p.withColumn("bucket_", F.floor(F.col("ts_us") / width))
    w = Window.partitionBy(*key_of(p), "bucket_").orderBy("ts_us", "seq")
    return p.withColumn("run_", F.sum(_bits(_flags(p), SYN | FIN | RST).cast("int")).over(w))


def _stated(p: DataFrame, linger_us: int) -> DataFrame:
    """Sums of runs by key, with ``nth``, the number of their connection, and ``both_``: whether both sides have opened it by then.

    A connection begins with a key's first packet; after a silence longer than its idle time; with a SYN that opens: the key's first one, one after payload, FIN or
    RST have passed since the SYN before, or one of another initial number (``tcp_seq``, where there is one) than its side's last. So a SYN
    sent twice and a simultaneous open begin nothing. Once every side seen has sent a FIN, or a RST was sent, a connection is closed: what comes without an
    opening SYN is still its own, and after each silence longer than ``linger_us`` a flow of strays.
    """
    key = key_of(p)
    flags, forward = _flags(p), F.col("forward")
    opening = flags.bitwiseAND(F.lit(SYN | ACK | FIN | RST)) == SYN
    size = F.length("payload") if "payload" in p.columns else F.col("len")
    isn = F.col("tcp_seq").cast("long") if "tcp_seq" in p.columns else F.lit(None).cast("long")
    opener = F.struct(F.when(_bits(flags, ACK), 1).otherwise(0).alias("rank"), "ts_us", "seq", (forward != _bits(flags, ACK)).alias("forward"))
    more = {
        "opens_": F.max(opening), "isn_": F.max(F.when(opening, isn)), "past_": F.max(~opening & ((size > 0) | _bits(flags, FIN | RST))),
        "syn_a": F.max(forward & _bits(flags, SYN)), "syn_b": F.max(~forward & _bits(flags, SYN)), "fin_a": F.max(forward & _bits(flags, FIN)), "fin_b": F.max(~forward & _bits(flags, FIN)),
        "ack_us": F.min(F.when(_bits(flags, ACK) & ~_bits(flags, SYN | RST), F.col("ts_us"))), "opener": F.min(F.when(_bits(flags, SYN), opener)),
    }
    r = _partial(_runs(p, linger_us), [*key, "idle_us", "bucket_", "run_"], more)
    w = Window.partitionBy(*key).orderBy("first")
    former = w.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({"at_": F.row_number().over(w), "gap_": F.col("start_us") - F.lag("end_us").over(w)})
    last = lambda c, rows=former: F.max(F.when(F.col(c) if isinstance(c, str) else c, F.col("at_"))).over(rows)
    number = lambda side: F.last(F.when(F.col("opens_") & (F.col("first.forward") == side), F.col("isn_")), ignorenulls=True).over(former)
    other = F.col("isn_") != F.when(F.col("first.forward"), number(True)).otherwise(number(False))
    anew = last("opens_").isNull() | F.coalesce(last("past_") >= last("opens_"), F.lit(False)) | F.coalesce(other, F.lit(False))
    r = r.withColumn("cut_", F.coalesce(F.col("gap_") > F.col("idle_us"), F.lit(True)) | (F.col("opens_") & anew))
    # All places are told in the one order of a key: what was last seen at or behind the place where the opening began was seen since.
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("begin_", last("cut_", upto))
    since = lambda c, rows=former: F.coalesce(last(c, rows) >= F.col("begin_"), F.lit(False))
    done = lambda side: since(f"fin_{side}") | ~since(F.col(f"packets_{side}") > 0)
    closed = (since(F.col("fin_a") | F.col("fin_b")) & done("a") & done("b")) | since(_bits(F.col("flags"), RST))
    late = closed & (F.col("gap_") > linger_us) & (F.col("proto") == 6)
    r = r.withColumn("cut_", F.col("cut_") | F.coalesce(late, F.lit(False)))
    r = r.withColumns({"nth": F.sum(F.col("cut_").cast("int")).over(w), "begin_": last("cut_", upto)})
    return r.withColumn("both_", since("syn_a", upto) & since("syn_b", upto))


def _connections(p: DataFrame, linger_us: int) -> DataFrame:
    sums = {n: make() for n, make in _SUMS.items()} | {c: F.max(c) for c in ("syn_a", "syn_b", "fin_a", "fin_b")}
    sums |= {"opener": F.min("opener"), "established_us": F.min(F.when(F.col("both_"), F.col("ack_us")))}
    return _stated(p, linger_us).groupBy(*key_of(p), "nth").agg(*(c.alias(n) for n, c in sums.items()))


def _idle(packets: DataFrame, idle: Column | None, directional: bool = False) -> DataFrame:
    return with_key(packets, directional).withColumn("idle_us", (idle_time(F.col("proto")) if idle is None else idle).cast("long"))


def flows(packets: DataFrame, idle: Column | None = None, directional: bool = False, linger_us: int = LINGER_US) -> DataFrame:
    """One row a flow of (seq, ts_us, proto, src_*, dst_*, len), ended by idle time; by the states of its connection too where there is ``tcp_flags``.

    ``directional``: each way is a flow of its own.

    Idle time alone: packets of a key within one stretch of idle time are one flow whatever else,
    so they are summed by key and stretch first, and only these sums are put in order. A hot key
    is thus split before any shuffle. With flags the runs between SYN, FIN and RST are summed by key and stretch first; the rules are those of ``_stated``.
    There are then ``established_us``, the first acknowledgement after both sides' SYN, and ``state``: reset, closed (every side seen has sent a
    FIN), half_closed, established, opening (a SYN was seen) or midstream. The reason is rst, fin (closed) or idle. The initiator is who sent
    the first SYN, whom the first SYN with ACK answers, or else who sent the first packet.
    """
    p = _idle(packets, idle, directional)
    if "tcp_flags" in packets.columns:
        return _finished(_connections(p, linger_us))
    return _finished(_numbered(p).groupBy(*key_of(p), "nth").agg(*(make().alias(n) for n, make in _SUMS.items())))


def tracked(packets: DataFrame, idle: Column | None = None, linger_us: int = LINGER_US) -> DataFrame:
    """Packets with their key and the ``start_us`` and ``end_us`` of their flow.

    A packet meets the one row of its key's stretch (with flags: of its run), so nothing multiplies and a hot key is split.
    """
    p = _idle(packets, idle)
    key = key_of(p)
    w = Window.partitionBy(*key, "nth")
    if "tcp_flags" in packets.columns:
        parts, place = _stated(p, linger_us), ["bucket_", "run_"]
        p = _runs(p, linger_us)
    else:
        parts, place = _numbered(p).withColumnRenamed("stretch", "bucket_"), ["bucket_"]
        p = p.withColumn("bucket_", F.floor(F.col("ts_us") / F.col("idle_us")))
    spans = parts.select(*key, *place, F.min("start_us").over(w).alias("start_us"), F.max("end_us").over(w).alias("end_us"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in [*key, *place]]
    return p.alias("p").join(spans.alias("s"), same).select(*(F.col(f"p.{c}") for c in p.columns if c not in (*place, "idle_us")), "s.start_us", "s.end_us")


def _finished(parts: DataFrame) -> DataFrame:
    stated = "opener" in parts.columns
    a = F.coalesce("opener.forward", "first.forward") if stated else F.col("first.forward")
    side = lambda x, own: F.when(a if own else ~a, F.col(f"{x}_a")).otherwise(F.col(f"{x}_b"))
    seconds = (F.col("end_us") - F.col("start_us")) / 1e6
    total = F.col("bytes_a") + F.col("bytes_b")
    reset, more = F.lit(False), []
    closed = F.lit(False)
    if stated:
        reset = _bits(F.col("flags"), RST) & (F.col("proto") == 6)
        one = F.col("fin_a") | F.col("fin_b")
        closed = one & (F.col("fin_a") | (F.col("packets_a") == 0)) & (F.col("fin_b") | (F.col("packets_b") == 0))
        state = F.when(reset, "reset").when(closed, "closed").when(one, "half_closed").when(F.col("established_us").isNotNull(), "established").when(F.col("syn_a") | F.col("syn_b"), "opening").otherwise("midstream")
        more = [F.col("established_us"), F.when(F.col("proto") == 6, state).alias("state")]
    return parts.select(
        *key_of(parts), "start_us", "end_us", "nth", a.alias("a_initiated"),
        side("packets", True).alias("packets_initiator"), side("packets", False).alias("packets_responder"),
        side("bytes", True).alias("bytes_initiator"), side("bytes", False).alias("bytes_responder"),
        F.when(reset, "rst").when(closed, "fin").otherwise("idle").alias("reason"),
        net.ratio(total * 8, seconds).alias("bits_per_s"), net.ratio(F.col("packets_a") + F.col("packets_b"), seconds).alias("packets_per_s"), *more,
    )


def records(f: DataFrame) -> DataFrame:
    """Flows of either family as export records: endpoints as text, community id, reason."""
    six = lambda x: F.col(f"{x}_ip6") if f"{x}_ip6" in f.columns else None
    ends = {x: net.ip_octets(F.col(f"{x}_ip4"), six(x)) for x in "ab"}
    ids = net.community_id_of(F.col("proto"), ends["a"], F.col("a_port"), ends["b"], F.col("b_port"))
    return f.withColumns({f"{x}_ip": net.ip_text(F.col(f"{x}_ip4"), six(x)) for x in "ab"} | {"community_id": ids})


def interim(packets: DataFrame, period_us: int, idle: Column | None = None) -> DataFrame:
    """Cumulative packets and bytes of each flow at every multiple of a period of its life, reason null: what an active timeout exports.

    Packets are summed by flow and period before they are put in order.
    """
    p = tracked(packets, idle)
    key = key_of(p)
    parts = p.groupBy(*key, "start_us", "end_us", F.floor((F.col("ts_us") - F.col("start_us")) / period_us).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("b"))
    run = Window.partitionBy(*key, "start_us").orderBy("k")
    parts = parts.withColumns({"packets": F.sum("n").over(run), "bytes": F.sum("b").over(run), "until": F.lead("k").over(run)})
    last = F.floor((F.col("end_us") - F.col("start_us")) / period_us) - 1
    ticks = parts.withColumn("until", F.coalesce(F.col("until") - 1, last)).filter("until >= k").withColumn("tick", F.explode(F.sequence("k", "until")))
    return ticks.select(*key, "start_us", (F.col("start_us") + (F.col("tick") + 1) * period_us).alias("at_us"), "packets", "bytes", F.lit(None).cast("string").alias("reason"))


def lifecycle(f: DataFrame) -> DataFrame:
    """started, established (where connections have states), ended and, where a reset ended it, rst events of flows, in one table."""
    event = lambda name, ts: F.struct(F.lit(name).alias("event"), F.col(ts).alias("ts_us"))
    rst = F.when(F.col("reason") == "rst", event("rst", "end_us"))
    open_ = [F.when(F.col("established_us").isNotNull(), event("established", "established_us"))] if "established_us" in f.columns else []
    some = F.array_compact(F.array(event("started", "start_us"), *open_, event("ended", "end_us"), rst))
    return f.withColumn("e", F.explode(some)).select("e.*", *f.columns, ((F.col("bytes_initiator") + F.col("bytes_responder")) == 0).alias("zero_payload"))


def active_at(f: DataFrame, at_us: int, idle: Column | None = None) -> DataFrame:
    idle = idle_time(F.col("proto")) if idle is None else idle
    return f.filter((F.col("start_us") <= at_us) & (F.col("end_us") > F.lit(at_us) - idle))


#: Runs of equal letters that are written as one piece of a history.
PIECE = 4096


def history(packets: DataFrame, by: list[str]) -> DataFrame:
    """The flag letters of all of each flow's packets in order, upper case from its first sender: its IPv4 or IPv6 address and, where ``by`` tells ports, its port.

    Runs of a letter are counted, and pieces of ``PIECE`` runs become text before a flow's pieces are put
    together, so that what is gathered is the text itself: a byte a packet.
    """
    w = Window.partitionBy(*by).orderBy("ts_us", "seq")
    flags = F.col("tcp_flags")
    bit = lambda b: _bits(flags, b)
    size = F.length("payload") if "payload" in packets.columns else F.col("len")
    letter = F.when(bit(SYN) & bit(ACK), "h").when(bit(SYN), "s").when(bit(RST), "r").when(bit(FIN), "f").when(size > 0, "d").otherwise("a")
    ends = [c for c in ("src_ip4", "src_ip6") if c in packets.columns] + (["src_port"] if {"a_port", "src_port"} & set(by) else [])
    sender = F.struct(*ends)
    own = sender.eqNullSafe(F.first(sender).over(w))
    p = packets.select(*by, "ts_us", "seq", F.when(own, F.upper(letter)).otherwise(letter).alias("c_"))
    p = p.withColumn("new_", F.coalesce((F.lag("c_").over(w) != F.col("c_")).cast("long"), F.lit(1).cast("long")))
    runs = p.withColumn("run_", F.sum("new_").over(w)).groupBy(*by, "run_", "c_").agg(F.count(F.lit(1)).cast("int").alias("k_"))
    text = lambda x, get: F.array_join(F.transform(F.array_sort(x), get), "")
    pieces = runs.groupBy(*by, F.floor(F.col("run_") / PIECE).alias("piece_")).agg(text(F.collect_list(F.struct("run_", "c_", "k_")), lambda s: F.repeat(s["c_"], s["k_"])).alias("x_"))
    return pieces.groupBy(*by).agg(text(F.collect_list(F.struct("piece_", "x_")), lambda s: s["x_"]).alias("history"))


def stretches(rows: DataFrame, by: list[str], order: list[str], side: str, size: str) -> DataFrame:
    """A conversation as runs of rows from one side: by, run, side, rows, size."""
    w = Window.partitionBy(*by).orderBy(*order)
    turn = F.coalesce((F.lag(side).over(w) != F.col(side)).cast("int"), F.lit(1))
    runs = rows.withColumn("turn_", turn).withColumn("run", F.sum("turn_").over(w))
    return runs.groupBy(*by, "run", side).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("size"))


def ordered_payload(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments (offset, payload) in order with ``fresh``: the part of payload no earlier offset has covered, and ``gap``: bytes missing before it.

    Overlaps go to the first copy. The stream stays a table: nothing gathers it whole.
    """
    w = Window.partitionBy(*by).orderBy("offset", F.length("payload").desc(), "seq")
    covered = F.coalesce(F.max(F.col("offset") + F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    s = segments.withColumn("covered", covered)
    skip = F.greatest(F.lit(0), F.col("covered") - F.col("offset")).cast("int")
    s = s.withColumns({"gap": F.greatest(F.lit(0), F.col("offset") - F.col("covered")), "fresh": F.substring("payload", skip + 1, F.length("payload"))})
    return s.filter(F.length("fresh") > 0).drop("covered")


def _assemble(timeout_us: int) -> Callable:
    """A step of folds.fold over (ts_us, offset, more, payload): the number of the datagram; null for a copy, and after an overlap.

    State: number, time of the first fragment, its fragments, their sorted places, bytes, end (once known), done, spoiled.
    """

    def step(state, t, offset, more, payload):
        nth, begin, parts, places, held, end, done, spoiled = state
        part = (offset, more, payload)
        aged = begin is None or t - begin > timeout_us
        if not aged and part in parts:
            return state, (None,)
        if aged or done:
            nth, begin, parts, places, held, end, done, spoiled = nth + 1, t, set(), [], 0, None, False, False
        elif spoiled:
            return state, (None,)
        place = (offset, offset + len(payload))
        at = bisect.bisect(places, place)
        spoiled = (at > 0 and places[at - 1][1] > place[0]) or (at < len(places) and places[at][0] < place[1]) or (not more and end is not None)
        parts.add(part)
        places.insert(at, place)
        held += len(payload)
        end = place[1] if not more else end
        done = not spoiled and held == end == places[-1][1]
        return (nth, begin, parts, places, held, end, done, spoiled), (nth,)

    return step


def whole_datagrams(fragments: DataFrame, timeout_us: int = 30_000_000, most_bytes: int = 65_535) -> DataFrame:
    """IPv4 fragments (src_ip4, dst_ip4, proto, ident, ts_us, offset, more, payload) put together: complete ones without gap or overlap, in time.

    An ident is used again: fragments go by in order of ts_us (and seq, where there is one), and once a datagram
    is complete, or the timeout since its first fragment is exceeded, the next fragment begins another. A fragment
    equal to one of the last datagram within that timeout is a copy. A datagram has at most 65,535 bytes,
    and nothing is taken after an overlap, which bounds what is held and gathered.
    """
    by = ["src_ip4", "dst_ip4", "proto", "ident"]
    order = ["ts_us", *(["seq"] if "seq" in fragments.columns else []), "offset"]
    f = fragments.filter(F.col("ts_us").isNotNull() & (F.col("offset") + F.length("payload") <= most_bytes)).select(*by, *order, "more", "payload")
    start = lambda: (0, None, set(), [], 0, None, False, False)
    f = folds.fold(f, by, order, ["ts_us", "offset", "more", "payload"], start, _assemble(timeout_us), {"nth": "long"}).filter("nth IS NOT NULL")
    w = Window.partitionBy(*by, "nth").orderBy("offset", "ts_us")
    expected = F.coalesce(F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("fits", F.col("offset") == expected)
    done = f.groupBy(*by, "nth").agg(
        F.bool_and("fits").alias("fits"), F.count_if(~F.col("more")).alias("ends"), F.min("ts_us").alias("ts_us"),
        F.array_sort(F.collect_list(F.struct("offset", "payload"))).alias("parts"),
    )
    body = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["payload"]))
    return done.filter((F.col("ends") == 1) & F.col("fits")).select(*by, "ts_us", body.alias("payload"), F.size("parts").alias("n_fragments"))


def running_clock(packets: DataFrame, by: str = "source_idx") -> DataFrame:
    """packets with ``clock_us``: the largest ts_us so far in the order of seq."""
    return packets.withColumn("clock_us", F.max("ts_us").over(Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
