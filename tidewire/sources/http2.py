"""HTTP/2 and gRPC without encryption: frames out of ordered streams, header lists by the state of their connection's compression.

One side's header blocks depend on all before them, so a side of a connection is read in order by one reader that holds its dynamic table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import streams

PREFACE = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
#: Types of frames and the flags that are read.
DATA, HEADERS, PUSH, CONTINUATION, SETTINGS = 0, 1, 5, 9, 4
END_STREAM, END_HEADERS, PADDED, PRIORITY = 1, 4, 8, 32
#: The static table, from 1.
STATIC = (
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"), (":status", "200"), (":status", "204"),
    (":status", "206"), (":status", "304"), (":status", "400"), (":status", "404"), (":status", "500"), ("accept-charset", ""), ("accept-encoding", "gzip, deflate"),
    *((n, "") for n in """accept-language accept-ranges accept access-control-allow-origin age allow authorization cache-control content-disposition content-encoding content-language content-length content-location
      content-range content-type cookie date etag expect expires from host if-match if-modified-since if-none-match if-range if-unmodified-since last-modified link location max-forwards proxy-authenticate
      proxy-authorization range referer refresh retry-after server set-cookie strict-transport-security transfer-encoding user-agent vary via www-authenticate""".split()),
)
#: Symbols of the header code by the number of their bits, in order; 256 ends a string. Codes follow by counting up.
_BY_BITS = {
    5: b"012aceiost", 6: b" %-./3456789=A_bdfghlmnpru", 7: b":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz", 8: b"&*,;XZ", 10: b'!"()?', 11: b"'+|", 12: b"#>", 13: b"\0$@[]~", 14: b"^}", 15: b"<`{", 19: b"\\\xc3\xd0",
    20: bytes.fromhex("808283a2b8c2e0e2"), 21: bytes.fromhex("99a1a7acb0b1b3d1d8d9e3e5e6"), 22: bytes.fromhex("81848586 88 92 9a 9c a0 a3a4 a9aa ad b2 b5 b9babb bdbe c4 c6 e4 e8e9"),
    23: bytes.fromhex("01 87 898a8b8c8d 8f 93 95969798 9b 9d9e a5a6 a8 aeaf b4 b6b7 bc bf c5 e7 ef"), 24: bytes.fromhex("09 8e 9091 94 9f ab ce d7 e1 eced"), 25: bytes.fromhex("c7 cf ea eb"),
    26: bytes.fromhex("c0c1 c8c9ca cd d2 d5 dadb ee f0 f2f3 ff"), 27: bytes.fromhex("cbcc d3d4 d6 dddedf f1 f4f5f6f7f8 fafbfcfdfe"),
    28: bytes([*range(2, 9), 11, 12, *range(14, 22), *range(23, 32), 127, 220, 249]), 30: bytes([10, 13, 22]),
}


def _codes() -> dict[tuple[int, int], int]:
    """(bits, code) of each symbol: codes of one length count up, and go on doubled with the next."""
    out, code, last = {}, 0, 5
    for bits, symbols in _BY_BITS.items():
        code <<= bits - last
        for s in symbols:
            out[bits, code] = s
            code += 1
        last = bits
    return out


_CODES = _codes()


def huffman(data: bytes) -> bytes:
    """The string that header code stands for; what is left at the end are at most 7 ones."""
    out, code, bits = bytearray(), 0, 0
    for byte in data:
        for k in range(7, -1, -1):
            code, bits = code << 1 | byte >> k & 1, bits + 1
            symbol = _CODES.get((bits, code))
            if symbol is not None:
                out.append(symbol)
                code = bits = 0
            elif bits >= 30:
                raise ValueError("no such code")
    if bits > 7 or code != (1 << bits) - 1:
        raise ValueError("padding of other bits than ones")
    return bytes(out)


class Table:
    """The decoder's side of header compression."""

    def __init__(self, most: int = 4096):
        self.own: list[tuple[str, str]] = []
        self.size, self.most, self.limit = 0, most, most

    def _number(self, data: bytes, at: int, bits: int) -> tuple[int, int]:
        top = (1 << bits) - 1
        n, at = data[at] & top, at + 1
        shift = 0
        while n >= top:
            byte, at = data[at], at + 1
            n += (byte & 127) << shift
            shift += 7
            if byte < 128:
                break
            if shift > 28:
                raise ValueError("a number too large")
        return n, at

    def _string(self, data: bytes, at: int) -> tuple[str, int]:
        coded = data[at] & 128
        n, at = self._number(data, at, 7)
        if at + n > len(data):
            raise ValueError("a string cut off")
        raw = data[at : at + n]
        return (huffman(raw) if coded else raw).decode("latin-1"), at + n

    def _get(self, index: int) -> tuple[str, str]:
        if index == 0 or index > len(STATIC) + len(self.own):
            raise ValueError("no such entry")
        return STATIC[index - 1] if index <= len(STATIC) else self.own[index - len(STATIC) - 1]

    def _shrink(self, to: int) -> None:
        while self.size > to and self.own:
            name, value = self.own.pop()
            self.size -= len(name) + len(value) + 32

    def read(self, block: bytes) -> list[tuple[str, str]]:
        """The header list of a block; the dynamic table moves on."""
        out, at = [], 0
        while at < len(block):
            first = block[at]
            if first & 128:
                index, at = self._number(block, at, 7)
                out.append(self._get(index))
                continue
            if first & 0xE0 == 0x20:
                to, at = self._number(block, at, 5)
                if to > self.limit:
                    raise ValueError("a table too large")
                self.most = to
                self._shrink(to)
                continue
            kept = first & 64
            index, at = self._number(block, at, 6 if kept else 4)
            name, at = (self._get(index)[0], at) if index else self._string(block, at)
            value, at = self._string(block, at)
            out.append((name, value))
            if kept:
                size = len(name) + len(value) + 32
                self._shrink(self.most - size)
                if size <= self.most:
                    self.own.insert(0, (name, value))
                    self.size += size
        return out


#: The largest table that is allowed for: what a peer may ask for with SETTINGS is sent the other way, so sizes up to this are taken.
TABLE = 1 << 16
#: The largest frame that is read, and the longest header block.
FRAME, BLOCK = 1 << 20, 1 << 18


def frames() -> streams.Reader:
    """(stream, headers, whether the stream ends with them) of each header block. Headers are lines of name, a tab and value. Sides begin with the preface or with SETTINGS."""
    table = Table()
    table.limit = TABLE
    state = {"begun": False, "block": bytearray(), "stream": 0, "ends": 0}

    def read(data: bytes) -> tuple[int, list[tuple], bool]:
        at, found = 0, []
        if not state["begun"]:
            if PREFACE.startswith(data[: len(PREFACE)]):
                if len(data) < len(PREFACE):
                    return 0, found, True
                at = len(PREFACE)
            elif len(data) < 9:
                return 0, found, True
            elif data[3] != SETTINGS or any(data[5:9]):
                return 0, found, False
            state["begun"] = True
        while at + 9 <= len(data):
            size, kind, flags = int.from_bytes(data[at : at + 3], "big"), data[at + 3], data[at + 4]
            stream = int.from_bytes(data[at + 5 : at + 9], "big") & 0x7FFFFFFF
            if size > FRAME:
                return at, found, False
            if at + 9 + size > len(data):
                break
            body = data[at + 9 : at + 9 + size]
            at += 9 + size
            if kind in (HEADERS, PUSH):
                if flags & PADDED:
                    body = body[1 : max(1, len(body) - body[0])] if body else body
                body = body[(5 if kind == HEADERS and flags & PRIORITY else 4 if kind == PUSH else 0) :]
                state["block"], state["stream"], state["ends"] = bytearray(body), stream, int(kind == HEADERS and flags & END_STREAM)
            elif kind == CONTINUATION:
                state["block"] += body
            else:
                continue
            if len(state["block"]) > BLOCK:
                return at, found, False
            if flags & END_HEADERS:
                try:
                    headers = table.read(bytes(state["block"]))
                except (ValueError, IndexError):
                    return at, found, False  # the state of the table is lost
                found.append((state["stream"], "\n".join(f"{n}\t{v}" for n, v in headers), state["ends"]))
        return at, found, True

    return read


def http2(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Header blocks of HTTP/2 over TCP: by, conn, nth, ts_us, stream, ends (1: the side is done with the stream), headers (name to value; of several the last), method, path, authority, status and content_type.

    gRPC's calls, told by their content type, have grpc_service and grpc_method; its answers' trailers grpc_status. A block that does not decode ends the reading of its side.
    """
    m = streams.messages(packets, frames, "stream long, told_ string, ends long", by)
    lines = F.filter(F.split("told_", "\n"), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.substring_index(x, "\t", 1).alias("k"), F.regexp_replace(x, "^[^\t]*\t", "").alias("v")))
    last = F.map_from_entries(F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda o: o["k"] == p["k"])))
    m = m.withColumn("headers", last)
    get = lambda name: F.col("headers")[name]
    m = m.withColumns({"method": get(":method"), "path": get(":path"), "authority": F.coalesce(get(":authority"), get("host")), "status": get(":status").try_cast("int"), "content_type": get("content-type"), "grpc_status": get("grpc-status").try_cast("int")})
    call = F.col("content_type").startswith("application/grpc") & F.col("method").isNotNull()
    parts = lambda k: F.when(call, F.nullif(F.regexp_extract("path", "^/([^/]+)/([^/]+)$", k), F.lit("")))
    return m.withColumns({"grpc_service": parts(1), "grpc_method": parts(2)}).drop("told_")
