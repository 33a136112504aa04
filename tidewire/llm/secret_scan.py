"""Secret scans through an inverted index of trigrams.

Each rule's regex is read once into a Boolean query over trigrams (of lower-cased ASCII bytes)
that any match must hold. Workers index the trigrams that some query names, block by block of
documents: a posting is the sorted array of the block's documents that hold it. Queries
intersect and unite postings; what is left is verified by the regex. A rule whose regex holds no
mandatory trigram scans every document in full.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import blocks


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Kinds in the order that breaks ties of equal starts. The later ones are published key formats. Fixed values.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ ){0,4}PRIVATE KEY-----"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_password", r"://[^\s/:@]{1,128}:[^\s/:@]{1,128}@"),
)
BASE = ("assign", "access", "hex")

#: At most so many alternative strings are followed at once; beyond it they are cut off there.
_STRINGS = 64


def _cross(a: set, b: set) -> set | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _STRINGS else None


def trigrams(strings: set) -> list[frozenset] | None:
    """An OR of ANDs: one set of trigrams a string; None if one of them is too short to have any."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)  # a subset makes the larger one needless


def query(pattern: str) -> list[list[frozenset]]:
    """An AND of ORs of ANDs of trigrams that every match of the pattern holds, lower-cased; empty if none is mandatory."""
    clauses: list[list[frozenset]] = []

    def walk(nodes) -> set | None:
        """The strings that nodes match if they are few; else None, with clauses for what must be in there."""
        now: set | None = {""}
        whole = True

        def cut(after: set | None) -> None:
            nonlocal now, whole
            if now and (t := trigrams(now)):
                clauses.append(t)
            now, whole = after, False

        for op, arg in nodes:
            name, found = str(op), None
            if name == "LITERAL":
                found = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                found = walk(arg[3])
            elif name == "IN" and not any(str(o) in ("NEGATE", "CATEGORY") for o, _ in arg):
                chars = {chr(c).lower() for o, a in arg for c in (range(a[0], min(a[1], a[0] + _STRINGS) + 1) if str(o) == "RANGE" else (a,))}
                found = chars if len(chars) <= 6 else None
            elif name == "BRANCH":
                kept = len(clauses)
                parts = [walk(x) for x in arg[1]]
                del clauses[kept:]  # clauses inside one alternative are not mandatory
                found = set().union(*parts) if all(p is not None for p in parts) else None
            elif name == "MAX_REPEAT" and arg[0] == 0:
                kept = len(clauses)
                once = walk(arg[2])
                del clauses[kept:]
                found = once | {""} if arg[1] == 1 and once is not None else None
            elif name == "MAX_REPEAT" and arg[0] == arg[1] == 1:
                found = walk(arg[2])
            elif name in ("AT", "ASSERT", "ASSERT_NOT"):
                continue
            if found is None:
                cut({""})
            elif (joined := _cross(now, found)) is not None:
                now = joined
            else:
                cut(found)
        if whole:
            return now
        cut(None)
        return None

    left = walk(parser.parse(pattern))
    if left and (t := trigrams(left)):
        clauses.append(t)
    return clauses


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdef"]] = True


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, dtype=bool)
        self.codes = {}
        for _, _, clauses in self.rules:
            for t in (t for clause in clauses for some in clause for t in some):
                a, b, c = t.encode("latin-1")
                self.codes[t] = a << 16 | b << 8 | c
        self.wanted[list(self.codes.values())] = True

    def index(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, np.ndarray]:
        """Postings of a block: code of a trigram -> its documents, sorted."""
        low = _LOWER[data].astype(np.uint32)
        if len(low) < 3:
            return {}
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
        at = np.flatnonzero(self.wanted[codes])
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) << 32 | doc[inside])
        if not len(pairs):
            return {}
        keys, begin = np.unique(pairs >> 32, return_index=True)
        return dict(zip(keys.tolist(), np.split(pairs & 0xFFFFFFFF, begin[1:]), strict=True))

    def candidates(self, clauses: list, postings: dict, n: int) -> np.ndarray:
        none = np.empty(0, dtype=np.int64)
        out = np.arange(n)
        for clause in clauses:
            any_ = none
            for some in clause:
                lists = sorted((postings.get(self.codes[t], none) for t in some), key=len)
                all_ = lists[0]
                for x in lists[1:]:
                    all_ = np.intersect1d(all_, x, assume_unique=True)
                any_ = np.union1d(any_, all_)
            out = np.intersect1d(out, any_, assume_unique=True)
        return out

    def scan(self, texts: pa.Array) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) in code points of each text, by start, then kind as listed."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        raw = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[raw[0] : raw[-1]] if texts.buffers()[2] else np.empty(0, np.uint8)
        offsets = raw - raw[0]
        postings = self.index(data, offsets)
        out: list[list] = [[] for _ in range(len(texts))]
        for order, (rule, regex, clauses) in enumerate(self.rules):
            for i in self.candidates(clauses, postings, len(texts)):
                body = texts[int(i)].as_py() if clauses or self._may(rule, i, data, offsets) else ""
                for m in regex.finditer(body):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), order, m.end()))
        return [[(self.rules[k][0].kind, a, b) for a, k, b in sorted(x)] for x in out]

    def _may(self, rule: Rule, i: int, data: np.ndarray, offsets: np.ndarray) -> bool:
        """The full scan: for runs of one class of characters a vectorised pass, else the regex itself."""
        if rule.kind != "hex":
            return True
        part = _HEX[data[offsets[i] : offsets[i + 1]]]
        if len(part) < rule.least:
            return False
        breaks = np.flatnonzero(~part)
        return bool(len(breaks) == 0 or max(breaks[0], len(part) - 1 - breaks[-1], np.max(np.diff(breaks), initial=0) - 1) >= rule.least)


_shared: list[Scanner] = []


def scanner() -> Scanner:
    """One a worker process."""
    if not _shared:
        _shared.append(Scanner())
    return _shared[0]


SPANS = "array<struct<kind:string,start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id and its secrets as ``spans``, by start, then kind.

    Spans of different rules may overlap. A null text has none; a null or repeated key is passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 1):
                found = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in scanner().scan(block.column(1))]
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in ``text`` replaced by a mark, overlapping ones by one; ``n_chars``, where there is one, follows.

    A null text stays null; texts are scanned whole, however long; repeated rows are treated alike and other columns are left alone.
    """
    at = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def clean(text: str, spans: list) -> str:
        out, done = [], 0
        for _, a, b in spans:
            if b > done:
                if a >= done:
                    out += [text[done:a], mark]
                done = b
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at):
                spans = scanner().scan(block.column(at))
                hit = [i for i, x in enumerate(spans) if x]
                if hit:
                    texts = block.column(at).to_pylist()
                    for i in hit:
                        texts[i] = clean(texts[i], spans[i])
                    columns = list(block.columns)
                    columns[at] = pa.array(texts, block.schema.field(at).type)
                    if chars is not None:
                        n = block.column(chars).to_pylist()
                        for i in hit:
                            n[i] = len(texts[i])
                        columns[chars] = pa.array(n, block.schema.field(chars).type)
                    block = pa.RecordBatch.from_arrays(columns, schema=block.schema)
                yield block

    return docs.mapInArrow(run, docs.schema)
