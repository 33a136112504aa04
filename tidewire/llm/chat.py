"""Chat formatting whose output parses back to the very same turns.

The grammar, turn by turn:

    turn := "<s>[INST] " body " [/INST]"              a user's turn
          | "<s>[ANSWER] " body " </s>"               an assistant's turn
          | "<s>[ROLE " name "] " body " [/ROLE]"     any other role

A backslash stands for the character after it; a body holds no unescaped control mark, a name no
unescaped "]". Each turn is rendered at the lowest level of escaping at which parsing it gives the
turn back: 0 as it is, 1 with a backslash before each control mark, 2 with one before each
backslash too. Level 2 always parses back. Turns end with their own mark, so those of a
conversation, joined, parse into the same turns, and each is rendered and checked by itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks

#: role: (what opens its turns, the mark that closes them)
FORMS = {"user": ("<s>[INST] ", "[/INST]"), "assistant": ("<s>[ANSWER] ", "</s>")}
OTHER = ("<s>[ROLE ", "[/ROLE]")
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANSWER]", "[ROLE", "[/ROLE]")
_MARK = re.compile("|".join(map(re.escape, MARKS)))
_IN_NAME = re.compile(r"\]")
_TOKEN = re.compile(r"\\.|" + _MARK.pattern, re.DOTALL)
_NAME_TOKEN = re.compile(r"\\.|" + _IN_NAME.pattern, re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
LEVELS = 3


def escape(text: str, level: int, marks: re.Pattern = _MARK) -> str:
    if level == 2:
        text = text.replace("\\", "\\\\")
    return marks.sub(lambda m: "\\" + m[0], text) if level else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _until(tokens: re.Pattern, mark: str, text: str, at: int) -> int:
    """Where the unescaped mark is that ends what starts at ``at``; -1 if another one comes first."""
    for m in tokens.finditer(text, at):
        if m[0][0] != "\\":
            return m.start() if m[0] == mark else -1
    return -1


def parse(text: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, the last two of its body as rendered; None if text is no list of turns."""
    out, at = [], 0
    while at < len(text):
        role, form = next(((r, f) for r, f in FORMS.items() if text.startswith(f[0], at)), (None, OTHER))
        start = at + len(form[0])
        if role is None:
            stop = _until(_NAME_TOKEN, "]", text, start) if text.startswith(OTHER[0], at) else -1
            if stop < 0 or text[stop + 1 : stop + 2] != " ":
                return None
            role, start = unescape(text[start:stop]), stop + 2
            if role in FORMS:
                return None
        end = _until(_TOKEN, form[1], text, start)
        if end <= start or text[end - 1] != " ":
            return None
        out.append((role, unescape(text[start : end - 1]), start, end - 1))
        at = end + len(form[1])
    return out


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """(rendered turn, start and end of its body, level of escaping)."""
    for level in range(LEVELS):
        opening, closing = FORMS.get(role, OTHER)
        if role not in FORMS:
            opening += escape(role, level, _IN_NAME) + "] "
        out = f"{opening}{escape(text, level)} {closing}"
        back = parse(out)
        if back and len(back) == 1 and back[0][:2] == (role, text):
            return out, back[0][2], back[0][3], level
    raise AssertionError("full escaping always parses back")


FORMATTED = "conv_id long, turn long, role string, rendered string, body_start long, body_end long, in_loss boolean, level int"


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn of (conv_id, turn, role, text): the rendered turn, where its body is, and whether it is under the loss mask.

    A conversation's formatted text is its rendered turns in the order of turn, role, rendered.
    Null texts and roles are empty ones; null ids and turns stay. Repeated rows are repeated turns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, 3):
                conv, turn, role, text = (block.column(i) for i in range(4))
                roles = [r or "" for r in role.to_pylist()]
                done = [render(r, t or "") for r, t in zip(roles, text.to_pylist(), strict=True)]
                cols = [conv, turn, pa.array(roles, pa.string()), *(pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))]
                cols += [pa.array([r == "assistant" for r in roles], pa.bool_()), pa.array([d[3] for d in done], pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["conv_id", "turn", "role", "rendered", "body_start", "body_end", "in_loss", "level"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, most_level int"


def digest(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from its rendered turns alone by the parser.

    A conversation goes by in order and leaves only its running hashes, so its length needs no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def row() -> tuple:
            conv, n, turns, chars, loss, size, level = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, level

        for batch in batches:
            done = []
            for block in blocks(batch, 1):
                for conv, text, level in zip(*(c.to_pylist() for c in block.columns), strict=True):
                    if not state or state[0] != conv:
                        if state:
                            done.append(row())
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, body, _, _ in parse(text):
                        state[1] += 1
                        state[2].update(f"{role}\n{body}\n".encode())
                        if role == "assistant":
                            state[3] += len(body)
                            state[4].update(body.encode())
                    state[5] += len(text)
                    state[6] = max(state[6], level)
            if done:
                yield _rows(done)
        if state:
            yield _rows([row()])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "rendered")
    return ordered.select("conv_id", "rendered", "level").mapInArrow(run, DIGEST)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
    names = [x.split()[0] for x in DIGEST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
