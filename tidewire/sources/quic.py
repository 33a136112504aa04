"""Client hellos of QUIC: Initial packets are unprotected with keys that follow from their connection id, and their CRYPTO frames put in order.

Workers cut Initial packets out of datagrams and derive their keys (a few HMACs a packet); the ciphers themselves are Spark's AES functions:
a block of ECB for the header's mask, GCM for the payload, which also proves that a packet is what it seems.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import decoders, streams

#: Salts of versions 1 and 2, the prefix of their labels, and the type bits of their Initial packets.
VERSIONS = {
    0x00000001: (bytes.fromhex("38762cf7f55934b34d179ae6a4c80cadccbb7f0a"), b"quic", 0),
    0x6B3343CF: (bytes.fromhex("0dede3def700a6db819381be6e269dcbf9bd2ed9"), b"quicv2", 1),
}


def _expand(secret: bytes, label: bytes, size: int) -> bytes:
    info = size.to_bytes(2, "big") + bytes([6 + len(label)]) + b"tls13 " + label + b"\0"
    return hmac.new(secret, info + b"\1", hashlib.sha256).digest()[:size]


@functools.lru_cache(maxsize=4096)
def keys(version: int, connection: bytes, side: bytes = b"client in") -> tuple[bytes, bytes, bytes]:
    """Key, iv and header key of one side's Initial packets, from the client's first destination connection id."""
    salt, prefix, _ = VERSIONS[version]
    secret = _expand(hmac.new(salt, connection, hashlib.sha256).digest(), side, 32)
    return _expand(secret, prefix + b" key", 16), _expand(secret, prefix + b" iv", 12), _expand(secret, prefix + b" hp", 16)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    """The number at a place and where it ends."""
    size = 1 << (data[at] >> 6)
    if at + size > len(data):
        raise IndexError(at)
    return int.from_bytes(data[at : at + size], "big") & ((1 << (8 * size - 2)) - 1), at + size


def initials(datagram: bytes) -> list[tuple[int, bytes, bytes, bytes]]:
    """(version, connection id, header up to the packet number, what follows) of each Initial packet of a datagram; others are passed over."""
    out, at = [], 0
    try:
        while at < len(datagram) and datagram[at] & 0xC0 == 0xC0:
            version = int.from_bytes(datagram[at + 1 : at + 5], "big")
            if version not in VERSIONS:
                break
            kind, size = (datagram[at] >> 4 & 3) - VERSIONS[version][2], datagram[at + 5]
            place = at + 6 + size
            connection = datagram[at + 6 : place]
            place += 1 + datagram[place]
            if kind == 0:
                token, place = _varint(datagram, place)
                place += token
            elif (kind & 3) == 3:  # a retry has no length
                break
            length, place = _varint(datagram, place)
            if place + length > len(datagram) or size > 20:
                break
            if kind == 0 and length >= 20:
                out.append((version, connection, datagram[at:place], datagram[place : place + length]))
            at = place + length
    except IndexError:
        pass
    return out


#: Frames of an Initial packet that are passed over or read: padding, ping, acknowledgements, crypto.
PADDING, PING, ACK, ACK_ECN, CRYPTO = 0, 1, 2, 3, 6


def crypto(payload: bytes) -> list[tuple[int, bytes]]:
    """(offset, data) of the CRYPTO frames of an Initial packet, up to the first frame that it may not hold."""
    out, at = [], 0
    try:
        while at < len(payload):
            kind = payload[at]
            at += 1
            if kind in (PADDING, PING):
                continue
            if kind in (ACK, ACK_ECN):
                fields = []
                for _ in range(4):
                    x, at = _varint(payload, at)
                    fields.append(x)
                for _ in range(2 * fields[2] + (3 if kind == ACK_ECN else 0)):
                    _, at = _varint(payload, at)
            elif kind == CRYPTO:
                offset, at = _varint(payload, at)
                size, at = _varint(payload, at)
                if at + size > len(payload):
                    break
                out.append((offset, payload[at : at + size]))
                at += size
            else:
                break
    except IndexError:
        pass
    return out


def _number(c: Column) -> Column:
    return F.conv(F.hex(c), 16, 10).cast("long")


def _octets(c: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(c), 2 * size, "0"))


def unprotected(packets: DataFrame, by: list[str]) -> DataFrame:
    """by, ts_us, seq, connection, payload: the decrypted payloads of clients' Initial packets over UDP. A packet that does not authenticate gives no row."""
    kept = [*by, "ts_us", "seq"]
    parts = [("version", pa.int64()), ("connection", pa.binary()), ("head", pa.binary()), ("rest", pa.binary()), ("key", pa.binary()), ("iv", pa.binary()), ("mask_key", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(i, *p, *keys(p[0], p[1])) for i, data in enumerate(batch.column(len(kept)).to_pylist()) for p in initials(data or b"")]
            if told:
                at, *columns = zip(*told, strict=True)
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *(pa.array(c, t) for c, (_, t) in zip(columns, parts, strict=True))], [*kept, *(n for n, _ in parts)])

    names = T._parse_datatype_string("version long, connection binary, head binary, rest binary, key binary, iv binary, mask_key binary")
    p = packets.filter("proto = 17").filter(F.length("payload") >= 64).select(*kept, "payload")
    p = p.mapInArrow(run, T.StructType([*(p.schema[k] for k in kept), *names.fields]))
    mask = F.aes_encrypt(F.substring("rest", 5, 16), F.col("mask_key"), F.lit("ECB"))
    p = p.withColumn("mask", F.substring(mask, 1, 5))
    first = _number(F.substring("head", 1, 1)).bitwiseXOR(_number(F.substring("mask", 1, 1)).bitwiseAND(F.lit(15)))
    p = p.withColumn("first", first).withColumn("size", F.col("first").bitwiseAND(F.lit(3)).cast("int") + 1)
    number = _number(F.substring(F.col("rest"), F.lit(1), F.col("size"))).bitwiseXOR(_number(F.substring(F.col("mask"), F.lit(2), F.col("size"))))
    p = p.withColumn("number", number)
    nonce = F.concat(F.substring("iv", 1, 8), _octets(_number(F.substring("iv", 9, 4)).bitwiseXOR(F.col("number")), 4))
    coded = F.unhex(F.lpad(F.hex("number"), F.col("size") * 2, F.lit("0")))
    bound = F.concat(_octets(F.col("first"), 1), F.substring("head", 2, 1 << 16), coded)
    sealed = F.substring(F.col("rest"), F.col("size") + 1, F.length("rest"))
    open_ = F.try_aes_decrypt(F.concat(nonce, sealed), F.col("key"), F.lit("GCM"), F.lit("DEFAULT"), bound)
    return p.select(*kept, "connection", open_.alias("payload")).filter("payload IS NOT NULL")


def hellos(packets: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Client hellos of QUIC over UDP (ts_us, seq, proto, payload and the columns ``by``): by, connection (the id), ts_us, sni, alpn and the other columns of ``decoders.tls``; JA4 as of QUIC.

    A hello may be cut over frames, packets and datagrams, in any order. Packets of a server, which have other keys, do not authenticate and give nothing.
    """
    by = streams.side_of(packets) if by is None else by
    p = unprotected(packets, by)
    kept = [*by, "connection", "ts_us", "seq"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(i, *f) for i, data in enumerate(batch.column(len(kept)).to_pylist()) for f in crypto(data)]
            if told:
                at, offset, data = zip(*told, strict=True)
                rows = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], pa.array(offset, pa.int64()), pa.array(data, pa.binary())], [*kept, "offset", "payload"])

    fields = T._parse_datatype_string("offset long, payload binary").fields
    parts = p.select(*kept, "payload").mapInArrow(run, T.StructType([*(p.schema[k] for k in kept), *fields])).filter(F.col("offset") < streams.HEAD)
    found = streams.cut(parts, [*by, "connection"], streams.bare_handshakes, "kind long, payload binary").filter("nth = 0 AND kind = 1")
    return decoders._hellos(found, decoders.hello_fields, "q").drop("kind", "payload", "nth")
