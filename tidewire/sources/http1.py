"""HTTP/1 messages out of ordered streams: heads in however many segments, and sizes and hashes of bodies that are never held."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import net
from . import capture, streams

_START = re.compile(rb"(?:(?:GET|HEAD|POST|PUT|DELETE|OPTIONS|PATCH|CONNECT|TRACE) \S+ HTTP/1\.[01]|HTTP/1\.[01] (\d{3}))")
_ANSWER = re.compile(rb"HTTP/1\.[01] \d{3}")
#: The longest head, and how many bytes of a body are kept to tell its type by.
HEAD, MAGIC = 1 << 16, 8


def messages() -> streams.Reader:
    """("head", message, head, null, null, null), and once its body is whole ("body", message, null, size, sha256, first bytes).

    Bodies go by their length or in chunks; one that ends with its connection has a head alone. What does not begin as a message ends the reading.
    """
    state = {"mode": "head", "left": 0, "n": -1, "size": 0, "hash": None, "magic": b"", "answer": False}

    def begin(mode: str, left: int = 0) -> None:
        state.update(mode=mode, left=left, size=0, hash=hashlib.sha256(), magic=b"")

    def take(data: bytes) -> None:
        state["hash"].update(data)
        state["size"] += len(data)
        if len(state["magic"]) < MAGIC:
            state["magic"] = (state["magic"] + data)[:MAGIC]

    def done(found: list) -> None:
        found.append(("body", state["n"], None, state["size"], state["hash"].hexdigest(), state["magic"]))
        state["mode"] = "head"

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        while True:
            mode = state["mode"]
            if mode == "head":
                end = data.find(b"\r\n\r\n", at)
                if end < 0:
                    return at, found, len(data) - at <= HEAD
                head = data[at:end]
                start = _START.match(head)
                if not start:
                    return at, found, False
                at, status = end + 4, int(start[1] or 0)
                state["n"] += 1
                found.append(("head", state["n"], head, None, None, None))
                low = head.lower()
                length = re.search(rb"\r\ncontent-length:\s*(\d{1,18})\s*(?:\r\n|$)", low)
                state["answer"] = bool(status)
                if status in (204, 304) or 100 <= status < 200 or low.startswith(b"connect "):
                    continue
                if re.search(rb"\r\ntransfer-encoding:[^\r\n]*chunked", low):
                    begin("chunk")
                elif length:
                    begin("body", int(length[1]))
                elif status:
                    return at, found, False  # until the connection ends
                continue
            if mode == "body":
                if state["answer"] and not state["size"] and state["left"]:  # the answer to HEAD has a length and no body
                    probe = data[at : at + 12]
                    if len(probe) < min(12, state["left"]) and b"HTTP/1.".startswith(probe[:7]):
                        return at, found, True
                    if _ANSWER.fullmatch(probe):
                        state["mode"] = "head"
                        continue
                part = data[at : at + state["left"]]
                take(part)
                at, state["left"] = at + len(part), state["left"] - len(part)
                if state["left"]:
                    return at, found, True
                done(found)
            elif mode == "chunk":
                end = data.find(b"\r\n", at)
                if end < 0:
                    return at, found, len(data) - at <= HEAD
                size = re.match(rb"([0-9A-Fa-f]{1,15})\s*(?:;|$)", data[at:end])
                if not size:
                    return at, found, False
                at, state["left"] = end + 2, int(size[1], 16)
                state["mode"] = "data" if state["left"] else "trailer"
            elif mode == "data":
                part = data[at : at + state["left"]]
                take(part)
                at, state["left"] = at + len(part), state["left"] - len(part)
                if state["left"] or len(data) < at + 2:
                    return at, found, True
                at, state["mode"] = at + 2, "chunk"
            else:  # trailers, up to an empty line
                end = data.find(b"\r\n", at)
                if end < 0:
                    return at, found, len(data) - at <= HEAD
                if end == at:
                    done(found)
                at = end + 2

    return read


def http_streams(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, conn, message (from 0), ts_us (of the head), the columns of ``capture.http``, and body_size, body_sha256 and body_type, null where a body is not whole or there is none."""
    by = streams.side_of(packets) if by is None else by
    m = streams.messages(packets, messages, "part string, message long, payload binary, body_size long, body_sha256 string, magic binary", by)
    keys = [*by, "conn", "message"]
    heads = capture.http(m.filter("part = 'head'").select(*keys, "ts_us", F.concat("payload", F.lit(b"\r\n\r\n")).alias("payload"))).drop("payload")
    bodies = m.filter("part = 'body'").select(*(F.col(k).alias(f"{k}_") for k in keys), "body_size", "body_sha256", net.file_type(F.col("magic")).alias("body_type"))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return heads.join(bodies, same, "left").drop(*(f"{k}_" for k in keys))
