"""Ordered patterns of events with other events between, and byte signatures across segments. Both carry the state of an automaton along a key's rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import streams
from . import folds


@dataclass(frozen=True)
class Step:
    """An event that ``when`` holds of. ``unless``: an event that ends the wait for it. ``strict``: it has to be the very next event. ``many``: one or more of them."""

    when: Column
    unless: Column | None = None
    strict: bool = False
    many: bool = False


def _advance(steps: list[Step], window_us: int):
    """A step of folds.fold over (ts_us, hits, breaks): for each number of steps done the latest begin of a partial match, as of rows so far.

    Of partial matches at one place the one begun last outlives all others, so one begin a place is all that is ever needed.
    """
    n = len(steps)
    strict = [s.strict for s in steps]
    many = [s.many for s in steps]

    def advance(state, t, hits, breaks):
        held = [b if b is not None and t - b <= window_us else None for b in state]
        new = [None] * n
        for i in range(n):
            if hits >> i & 1:
                came = t if i == 0 else held[i - 1]
                if many[i] and held[i] is not None:
                    came = held[i] if came is None else max(came, held[i])
                new[i] = came
        out = []
        for i in range(n - 1):
            stays = held[i] if not strict[i + 1] and not breaks >> (i + 1) & 1 else None
            out.append(stays if new[i] is None else new[i] if stays is None else max(stays, new[i]))
        out.append(new[n - 1] if many[n - 1] else None)
        return out, (new[n - 1],)

    return advance


def matches(rows: DataFrame, keys: list[str], steps: list[Step], window_us: int, once: bool = False, order: str = "seq") -> DataFrame:
    """Events (keys, ts_us, order) that end a match of all steps in order within the window (inclusive), with ``began_us`` (of the match begun last) and ``took_us``.

    Any other events may lie between steps. A match looks back no further than the window, so events are dealt by key and stretch of the window, with
    copies to the stretch after it that end nothing there: a hot key is split over time. ``once``: a match may not begin before the last one that
    counted has ended; that is told of the matches alone, key by key. Rows without ts_us are left out; at one time ``order`` decides.
    """
    if not steps:
        raise ValueError("a pattern has one step or more")
    bits = lambda columns: sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(columns) if c is not None), F.lit(0)).cast("long")
    p = rows.filter("ts_us IS NOT NULL").select(*keys, "ts_us", order, bits([s.when for s in steps]).alias("hits_"), bits([s.unless for s in steps]).alias("breaks_"))
    if not any(s.strict for s in steps):
        p = p.filter("hits_ <> 0 OR breaks_ <> 0")
    own = F.floor(F.col("ts_us") / (window_us + 1))
    p = p.withColumn("own_", own).withColumn("stretch_", F.explode(F.array("own_", F.col("own_") + 1)))
    n = len(steps)
    start = lambda: [None] * n
    found = folds.fold(p, [*keys, "stretch_"], ["ts_us", order], ["ts_us", "hits_", "breaks_"], start, _advance(steps, window_us), {"began_us": "long"})
    out = found.filter("began_us IS NOT NULL AND stretch_ = own_").select(*keys, order, "ts_us", "began_us", (F.col("ts_us") - F.col("began_us")).alias("took_us"))
    if not once:
        return out

    def apart(last, began, t):
        fine = last is None or began > last
        return (t if fine else last), (fine,)

    return folds.fold(out, keys, ["ts_us", order], ["began_us", "ts_us"], lambda: None, apart, {"fine_": "boolean"}).filter("fine_").drop("fine_")


@dataclass(frozen=True)
class Signature:
    """Byte strings by name, and a Spark SQL condition over ``n_<name>`` (how often), ``first_<name>`` and ``last_<name>`` (where, from 0; null if never) and ``size``."""

    name: str
    strings: dict[str, bytes]
    condition: str
    nocase: frozenset = frozenset()


class _Automata:
    """One automaton for exact strings and one for those whose case does not count, over bytes read as Latin-1."""

    def __init__(self, strings: list[tuple[bytes, bool]]):
        import ahocorasick

        self.sizes = [len(s) for s, _ in strings]
        self.all = []
        for folded in (False, True):
            words: dict[str, list[int]] = {}
            for i, (s, nocase) in enumerate(strings):
                if nocase == folded:
                    words.setdefault((s.lower() if folded else s).decode("latin-1"), []).append(i)
            if words:
                a = ahocorasick.Automaton()
                for w, numbers in words.items():
                    a.add_word(w, numbers)
                a.make_automaton()
                self.all.append((folded, a))

    def start(self) -> list:
        return [a.iter("") for _, a in self.all]

    def feed(self, state: list, data: bytes) -> Iterator[tuple[int, int]]:
        """(number of a string, the place of its last byte since the start) in data that follows what was fed before."""
        for (folded, _), it in zip(self.all, state, strict=True):
            it.set((data.lower() if folded else data).decode("latin-1"), False)
            for end, numbers in it:
                for i in numbers:
                    yield i, end


def counted(packets: DataFrame, strings: list[tuple[bytes, bool]], by: list[str] | None = None) -> DataFrame:
    """Of each stream of packets (by, conn): ts_us of its last segment, size, and arrays over the strings (bytes, whether case is nothing): n, first, last.

    TCP is read in order of its bytes, other protocols in order of time. Every occurrence counts, overlapping ones too. An automaton goes from segment to segment, so
    a string may be cut anywhere; a gap sets it back, as what is missing is not known. A stream of any length holds one state.
    """
    if not strings or any(not s for s, _ in strings):
        raise ValueError("strings of one byte or more")
    by = streams.side_of(packets) if by is None else by
    keys = [*by, "conn"]
    parts = streams.placed(packets, by)
    if "proto" in packets.columns:
        w = Window.partitionBy(*by).orderBy("ts_us", "seq")
        rest = packets.filter("proto <> 6").filter(F.length("payload") > 0)
        before = F.coalesce(F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = parts.unionByName(rest.select(*by, F.lit(0).cast("long").alias("conn"), before.alias("offset"), "ts_us", "seq", "payload"))
    p = parts.select(*keys, "offset", "ts_us", "payload", F.length("payload").alias("size_"), "seq")
    n = len(strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = _Automata(strings)
        own = None

        def begin(key: tuple) -> None:
            nonlocal own, covered, base, last_us, size, state, tallies
            own, covered, base, last_us, size = key, 0, 0, None, 0
            state, tallies = automata.start(), ([0] * n, [None] * n, [None] * n)

        def told() -> tuple:
            return (*own, last_us, size, *tallies)

        covered = base = size = 0
        last_us, state, tallies, done = None, None, None, []
        schema = None
        for batch in batches:
            schema = schema or [f.type for f in batch.schema][: len(keys)]
            for *key, offset, ts, payload in zip(*(batch.column(i).to_pylist() for i in range(len(keys) + 3)), strict=True):
                if own != tuple(key):
                    if own is not None:
                        done.append(told())
                    begin(tuple(key))
                last_us = ts if last_us is None else max(ts, last_us)
                if offset + len(payload) <= covered:
                    continue
                if offset > covered:
                    state, base = automata.start(), offset
                fresh = payload[max(0, covered - offset) :]
                for i, end in automata.feed(state, fresh):
                    at = base + end - automata.sizes[i] + 1
                    tallies[0][i] += 1
                    tallies[1][i] = at if tallies[1][i] is None else min(at, tallies[1][i])
                    tallies[2][i] = at if tallies[2][i] is None else max(at, tallies[2][i])
                covered = offset + len(payload)
                size += len(fresh)
            if done:
                yield _streams(done, schema, names)
                done = []
        if own is not None:
            yield _streams([told()], schema, names)

    names = [*keys, "ts_us", "size", "n", "first", "last"]
    types = [f"`{k}` {p.schema[k].dataType.simpleString()}" for k in keys]
    out = ", ".join([*types, "ts_us long, size long, n array<long>, first array<long>, last array<long>"])
    return p.repartition(*keys).sortWithinPartitions(*keys, "offset", F.desc("size_"), "seq").select(*keys, "offset", "ts_us", "payload").mapInArrow(run, out)


def _streams(rows: list[tuple], key_types: list, names: list[str]) -> pa.RecordBatch:
    types = [*key_types, pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def signatures(packets: DataFrame, rules: list[Signature], by: list[str] | None = None) -> DataFrame:
    """A row a stream and signature that holds: by, conn, ts_us, size, rule. All strings of all rules go by in one pass."""
    named = {(r.name, x): (s, x in r.nocase) for r in rules for x, s in r.strings.items()}
    strings = list(dict.fromkeys(named.values()))
    c = counted(packets, strings, by)
    keys = c.columns[: c.columns.index("ts_us")]
    hits = []
    for k, r in enumerate(rules):
        own = [F.col("size")]
        for x in r.strings:
            i = strings.index(named[r.name, x])
            own += [F.get(t, F.lit(i)).alias(f"{t}_{x}") for t in ("n", "first", "last")]
        c = c.withColumn(f"rule_{k}_", F.struct(*own))
    for k, r in enumerate(rules):
        # the condition's own names are those of its struct
        hits.append(F.when(F.coalesce(_within(r, f"rule_{k}_"), F.lit(False)), F.lit(r.name)))
    return c.select(*keys, "ts_us", "size", F.explode(F.array_compact(F.array(*hits))).alias("rule"))


def _within(rule: Signature, column: str) -> Column:
    """The condition over the fields of a struct column: a lambda's argument has them as names would."""
    text = rule.condition
    for name in sorted([f"{t}_{x}" for x in rule.strings for t in ("n", "first", "last")] + ["size"], key=len, reverse=True):
        text = _replaced(text, name, f"{column}.`{name}`")
    return F.expr(text)


def _replaced(text: str, name: str, by: str) -> str:
    return re.sub(rf"(?<![\w.`]){re.escape(name)}(?!\w)", lambda _: by, text)
