"""Repair of the structure of conversations by A* on the edit lattice.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``. A node of the lattice is a number of
rows read and a state: nothing written yet, after the system's turn, after a user's, after an assistant's. Edits lead on:

    Keep 0 | Rerole to user or assistant 2 | Delete 3 (the only one for blank and duplicate rows) | Insert an empty turn 2

and a truncated row that stays costs 1. The heuristic is a sum over the rows to come: 3 for each that has to be
deleted, 1 for each truncated one. It never overrates and never drops by more than an edge costs, so a node is settled when first
taken. Nodes are taken by (cost plus heuristic, audit), the audit being the edits' initials so far: of the cheapest scripts
the ASCII-least wins. Two scripts of one cost to one node are never prefixes of each other, so that their order stays.

Rows become one byte each (role and fault) before a search; a conversation beyond ``CHUNK`` rows is searched chunk by chunk from its
end, from each state, with the costs of the chunk behind as exits, so that a search stays small. Texts go by once, after the
audits are known, as a sorted stream that holds one row.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import blocks

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: Where an inserted or reroled turn leads from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a kept row of a role (s, u, a, other) leads from each state; None: nowhere.
KEPT = ((SYSTEM, None, None, None), (USER, USER, None, USER), (None, None, ASSISTANT, None), (None,) * 4)
LEGAL = {(0, 1), (1, 2), (2, 1)}
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: A search holds at most four audits of each length up to so many rows.
CHUNK = 512


def _inside(text: Column) -> Column:
    return text.rlike(r"[^\x20\x09-\x0D]")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 takes out [.!?], 3 repeats, 4 makes it a user's. Nulls count as one space; a null conv_id or turn stays null itself."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k_"),
    )
    text = F.when(F.col("k_") == 1, "").when(F.col("k_") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k_") == 4, "user").otherwise(F.col("role"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("k_") == 3, 2).otherwise(1))
    return c.filter("k_ <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy_")).drop("copy_")


def faults(turns: DataFrame) -> DataFrame:
    """Turns without their texts: conv_id, turn, role, the text's digest, and ``code``: role (s, u, a, other) times 4 plus the first fault.

    Duplicates are told by (conv_id, role, text), so a long conversation is split.
    """
    t = turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), _inside(F.col("text")).alias("in_"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ends_"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("in_"), BLANK).when(F.col("again_"), DUPLICATE).when(~F.col("ends_"), TRUNCATED).otherwise(NO_FAULT)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return t.withColumn("again_", again).select("conv_id", "turn", "role", "digest", (role * 4 + fault).cast("int").alias("code"))


def search(codes: bytes, entry: int, exits: dict[int, int] | None) -> tuple[int, str, int]:
    """(cost, audit, last state) of the cheapest, then ASCII-least script over rows from a state.

    ``exits``: what comes after the last row costs from each state; nothing is inserted after that row then. None: the conversation ends.
    """
    n = len(codes)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = codes[i] & 3
        ahead[i] = ahead[i + 1] + (DELETE if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0)
    open_: list[tuple[int, str, int, int, int]] = [(ahead[0], "", 0, entry, 0)]
    settled = set()
    while True:
        _, audit, i, state, cost = heapq.heappop(open_)
        if i > n:
            return cost, audit, state
        if (i, state) in settled:
            continue
        settled.add((i, state))
        edges = []
        if i < n:
            role, fault = codes[i] >> 2, codes[i] & 3
            edges.append(("D", i + 1, state, DELETE))
            if fault not in (BLANK, DUPLICATE):
                cut = CUT if fault == TRUNCATED else 0
                edges.append(("R", i + 1, NEXT[state], REROLE + cut))
                if KEPT[role][state] is not None:
                    edges.append(("K", i + 1, KEPT[role][state], cut))
        if i < n or exits is None:
            edges.append(("I", i, NEXT[state], INSERT))
        for edit, j, to, price in edges:
            if (j, to) not in settled:
                heapq.heappush(open_, (cost + price + ahead[j], audit + edit, j, to, cost + price))
        if i == n and (exits is not None or state in (START, ASSISTANT)):
            total = cost + (exits[state] if exits is not None else 0)
            heapq.heappush(open_, (total, audit, n + 1, state, total))


def solve(codes: bytes, chunk: int = CHUNK) -> tuple[int, str]:
    """(cost, audit) of a conversation."""
    parts = [codes[i : i + chunk] for i in range(0, len(codes), chunk)] or [b""]
    exits, found = None, []
    for k in range(len(parts) - 1, -1, -1):
        found.append({s: search(parts[k], s, exits) for s in (range(4) if k else (START,))})
        exits = {s: cost for s, (cost, _, _) in found[-1].items()}
    state, audit = START, []
    for part in reversed(found):
        _, text, state = part[state]
        audit.append(text)
    return exits[START], "".join(audit)


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A row a conversation of turns (conv_id, turn, role, text; no null role or text): gaps, faults, illegal neighbours, and the cheapest script with its cost.

    Turns are in order of turn (nulls first), role and the text's md5. ``ids`` (conv_id): conversations that get a row even without turns.
    """
    rows = faults(turns)
    if ids is not None:
        rows = rows.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct(), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        own: tuple | None = None
        codes, turns_ = bytearray(), [None, None, 0]

        def row() -> tuple:
            kinds = [c & 3 for c in codes]
            roles = [c >> 2 for c in codes]
            illegal = sum(pair not in LEGAL for pair in zip(roles, roles[1:], strict=False))
            least, most, distinct = turns_
            gaps = most - least + 1 - distinct if distinct else 0
            return (own[0], gaps, kinds.count(BLANK), kinds.count(DUPLICATE), kinds.count(TRUNCATED), illegal, *solve(bytes(codes)))

        for batch in batches:
            for conv, turn, code in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if own is None or own[0] != conv:
                    if own is not None:
                        done.append(row())
                    own, codes, turns_ = (conv,), bytearray(), [None, None, 0]
                if code is None:
                    continue
                codes.append(code)
                if turn is not None and turn != turns_[1]:
                    turns_ = [turn if turns_[0] is None else turns_[0], turn, turns_[2] + 1]
            if done:
                yield _batch(done, AUDIT)
                done = []
        if own is not None:
            yield _batch([row()], AUDIT)

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return ordered.select("conv_id", "turn", "code").mapInArrow(run, AUDIT)


REPAIRED = "conv_id long, place long, role string, text string, edit string"


def repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), role, text, and the edit that made them (K, R or I). A conversation's rows come together and in order.

    An audit goes before its conversation's turns in one sorted stream, so a task holds an audit and a row.
    """
    t = turns.select("conv_id", F.lit(1).alias("tag_"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest_"), "text")
    a = audited.select("conv_id", F.lit(0).alias("tag_"), F.col("audit").alias("text"))
    both = t.unionByName(a, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "tag_", "turn", "role", "digest_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, audit, at, state, place = None, "", 0, START, 0

        def write(role: str, text: str, edit: str) -> None:
            nonlocal place
            out.append((conv, place, role, text, edit))
            place += 1

        def insert() -> None:
            nonlocal at, state
            while audit[at : at + 1] == "I":
                at, state = at + 1, NEXT[state]
                write(ROLES[state], "", "I")

        for batch in batches:
            for block in blocks(batch, 3):
                for id_, tag, role, text in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if tag == 0:
                        insert()
                        conv, audit, at, state, place = id_, text, 0, START, 0
                        continue
                    insert()
                    edit, at = audit[at], at + 1
                    if edit == "R":
                        state = NEXT[state]
                        write(ROLES[state], text, edit)
                    elif edit == "K":
                        state = KEPT["sua".find(role[0])][state]
                        write(role, text, edit)
                if out:
                    yield _batch(out, REPAIRED)
                    out = []
        insert()
        if out:
            yield _batch(out, REPAIRED)

    return both.select("conv_id", "tag_", "role", "text").mapInArrow(run, REPAIRED)


def digest(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of ``repaired``'s rows as they come: of ``role:text``, newline-joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        done, hash_ = [], hashlib.sha256()
        for batch in batches:
            for block in blocks(batch, 2):
                for conv, role, text in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if own is None or own[0] != conv:
                        if own is not None:
                            done.append((own[0], hash_.hexdigest()))
                        own, hash_ = (conv,), hashlib.sha256()
                    else:
                        hash_.update(b"\n")
                    hash_.update(f"{role}:{text}".encode())
            if done:
                yield _batch(done, "conv_id long, repaired_sha256 string")
                done = []
        if own is not None:
            yield _batch([(own[0], hash_.hexdigest())], "conv_id long, repaired_sha256 string")

    return rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``audits`` with repaired_sha256; the empty text's where nothing is left. Null roles and texts of turns count as one space."""
    t = turns.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})
    a = materialize(audits(t, ids), "audits")
    d = digest(repaired(t, a)).withColumnRenamed("conv_id", "own_")
    out = a.join(d, F.col("conv_id").eqNullSafe(F.col("own_")), "left").drop("own_")
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])
