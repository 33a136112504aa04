"""Scoring text by a language model: prediction by partial matching over bytes, beside a word unigram base.

Prediction by partial matching: the training corpus fills a trie of byte contexts up to an order
with the counts of what followed. A byte is predicted in its longest context; where that context
has not seen it, the context's escape estimate (distinct followers over followers plus distinct
followers) is paid and the next shorter one predicts, without the symbols that the longer ones
would have predicted. Last come equal shares of what is left of the 256 symbols. The start and
the end of a text are symbols that UTF-8 never holds, so that the model is a distribution over
texts.

Neither words nor long contexts have a bound. Each worker tells blocks of documents, and for each
block its distinct words and its distinct grams (a context of full order with the symbol after it),
dealt out to buckets whose number follows the corpus: words by a checksum, grams by the last three
bytes of their context. A bucket's words, or grams, of a block are one compressed row, sorted so that
neighbours are alike. There they meet their counts of all blocks and go back to their block as code
lengths. So a word or a gram moves once a block, however often it occurs, and no task sees the
vocabulary or the trie. As all blocks have the grams of the commonest contexts, grams are summed by
bucket and group of blocks before they are summed by bucket, and looked up a group at a time. Only
orders 0 to 2, at most 256 ** 3 counts whatever the corpus, are broadcast.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize
from .tokens import blocks

#: Bytes that no UTF-8 text holds: before a text's first byte, and after its last one.
START, END = 0xFE, 0xFF
BLOCK_BYTES = 4 << 20
#: Text a block whose words and grams are looked up together.
WORDS_BYTES = 4 << 20
#: Grams looked at at once.
WINDOW = 1 << 20
#: Order of the registered query's model.
ORDER = 5
#: Training text a bucket of words or grams, beside the first buckets, and blocks a group.
BUCKET_BYTES, BUCKETS, GROUP_BLOCKS = 32 << 20, 64, 1024
#: Training text for each task of the last stage, at least.
TASK_BYTES = 64 << 20


def _laid(raw: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of the texts in a row, the places of grams (not those that end in a text's start), and each text's number of them."""
    data = np.frombuffer(b"".join(bytes((START,)) * order + t + bytes((END,)) for t in raw), np.uint8)
    sizes = np.array([len(t) + 1 for t in raw])
    keep = np.ones(max(0, len(data) - order), dtype=bool)
    begin = np.cumsum(sizes + order)[:-1] - order
    for i in range(order):
        keep[begin + i] = False
    return data, keep, sizes


def _codes(data: np.ndarray, order: int, a: int, b: int) -> np.ndarray:
    codes = np.zeros(b - a, dtype=np.int64)
    for i in range(order + 1):
        codes <<= 8
        codes |= data[a + i : b + i]
    return codes


def symbols(raw: list[bytes], order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams (order symbols and the next) that the texts' bytes and ends close, and each text's number of them."""
    data, keep, sizes = _laid(raw, order)
    return _codes(data, order, 0, len(keep))[keep], sizes


def turned(codes: np.ndarray, order: int, back: bool = False) -> np.ndarray:
    """Codes with the last three symbols of the context before the earlier ones, so that those of a bucket are close when sorted; or ``back``."""
    head, tail = 8 * max(0, order - 3), 8 * min(3, order)
    if back:
        return (codes >> 8 & (1 << head) - 1) << tail + 8 | (codes >> head + 8) << 8 | codes & 255
    return (codes >> 8 & (1 << tail) - 1) << head + 8 | (codes >> tail + 8) << 8 | codes & 255


def distinct(raw: list[bytes], order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct turned codes of the texts in order of bucket and code, each one's bucket, where among them each gram's is, and each text's number of grams.

    Texts are walked a window at a time, across their bounds, so that only 4 bytes a gram are held.
    """
    data, keep, sizes = _laid(raw, order)
    each = []
    for a in range(0, len(keep), WINDOW):
        b = min(a + WINDOW, len(keep))
        coded = pa.array(turned(_codes(data, order, a, b)[keep[a:b]], order)).dictionary_encode()
        each.append((coded.dictionary.to_numpy(), coded.indices.to_numpy()))
    found = np.unique(np.concatenate([x for x, _ in each]))
    bucket = ((found >> 8 * max(1, order - 2)) * 2654435761 & 0xFFFFFFFF) // 256 % buckets
    ranked = np.argsort(bucket, kind="stable")
    rank = np.empty(len(ranked), dtype=np.int32)
    rank[ranked] = np.arange(len(ranked), dtype=np.int32)
    return found[ranked], bucket[ranked], np.concatenate([rank[np.searchsorted(found, x)][at] for x, at in each]), sizes


def _times(where: np.ndarray, counts: np.ndarray, kinds: int) -> np.ndarray:
    """How often each kind occurs where ``counts`` holds."""
    out = np.zeros(kinds, dtype=np.int64)
    for a in range(0, len(where), WINDOW):
        out += np.bincount(where[a : a + WINDOW][counts[a : a + WINDOW]], minlength=kinds)
    return out.astype("<u4")


def distinct_words(flat: pa.Array, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The same of words."""
    coded = flat.dictionary_encode()
    found = coded.dictionary.cast(pa.large_binary()).to_pylist()
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in found), np.int64, len(found))
    ranked = pc.sort_indices(pa.table([pa.array(bucket), coded.dictionary], names=["bucket", "word"]), [("bucket", "ascending"), ("word", "ascending")]).to_numpy()
    rank = np.empty(len(ranked), dtype=np.int32)
    rank[ranked] = np.arange(len(ranked), dtype=np.int32)
    return [found[i] for i in ranked.tolist()], bucket[ranked], rank[coded.indices.to_numpy(zero_copy_only=False)]


def pack(x: np.ndarray) -> bytes:
    """The array's bytes, all first ones before all second ones, compressed."""
    return zstandard.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(x: bytes, of: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(of).itemsize, -1).T.copy().view(of).ravel()


class Trie:
    """Code lengths of every symbol after every context of two symbols, from counts of trigrams."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        codes, counts = np.asarray(codes, dtype=np.int64), np.asarray(counts, dtype=np.float64)
        self.codes, which = np.unique(codes, return_inverse=True)
        self.counts = np.bincount(which, counts, minlength=len(self.codes))
        seen, row = np.unique(codes >> 8, return_inverse=True)
        order2 = np.zeros((len(seen), 256))
        np.add.at(order2, (row, codes & 255), counts)
        order1 = np.zeros((256, 256))
        np.add.at(order1, ((codes >> 8) & 255, codes & 255), counts)
        order0 = order1.sum(axis=0)
        # contexts never seen share the row of their last symbol, and that one the empty context's
        last = np.flatnonzero(order1.any(axis=1))
        self.row = np.full(1 << 16, len(seen) + len(last), dtype=np.int32)
        for i, c in enumerate(last):
            self.row[c :: 256] = len(seen) + i
        self.row[seen] = np.arange(len(seen))
        rows = [self._rows(levels) for levels in self._levels(order2, seen, order1, last, order0)]
        self.lengths = np.concatenate(rows).astype(np.float32)
        self.total, self.distinct = np.zeros(len(self.lengths)), np.zeros(len(self.lengths))
        self.total[: len(seen)], self.distinct[: len(seen)] = order2.sum(axis=1), (order2 > 0).sum(axis=1)

    @staticmethod
    def _levels(order2, seen, order1, last, order0, step: int = 2048):
        for at in range(0, len(seen), step):
            c = seen[at : at + step]
            yield [order2[at : at + step], order1[c & 255], np.broadcast_to(order0, (len(c), 256))]
        yield [order1[last], np.broadcast_to(order0, (len(last), 256))]
        yield [order0[None, :]]

    @staticmethod
    def _rows(levels: list[np.ndarray]) -> np.ndarray:
        """log10 of each symbol's probability, a row a context; levels from the longest context to the empty one."""
        n = len(levels[0])
        out = np.zeros((n, 256))
        excluded, paid = np.zeros((n, 256), dtype=bool), np.zeros((n, 1))
        for counts in levels:
            counts = np.where(excluded, 0, counts)
            total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
            rest = (~excluded).sum(axis=1, keepdims=True) - distinct  # nothing left to escape to: no escape
            whole = np.where(total > 0, total + np.where(rest > 0, distinct, 0), 1)
            with np.errstate(divide="ignore"):
                out = np.where(counts > 0, paid + np.log10(counts / whole), out)
                paid = paid + np.where((total > 0) & (rest > 0), np.log10(np.maximum(distinct, 1) / whole), 0)
            excluded |= counts > 0
        left = (~excluded).sum(axis=1, keepdims=True)
        return np.where(excluded, out, paid - np.log10(np.maximum(left, 1)))

    def count(self, codes: np.ndarray) -> np.ndarray:
        """How often each trigram was seen."""
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)

    def predict(self, grams: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context of the order, 2 at least.

        grams are distinct, with how often each was seen (or 0); with a gram come all others whose contexts
        end in the same three symbols. What followed a context has followed each shorter one, so what is
        excluded at an order is what the next longer context has seen.
        """
        out, paid, open_ = np.zeros(len(grams)), np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
        gone, kinds = np.zeros(len(grams)), np.zeros(len(grams))  # sum and number of the excluded followers

        def level(n: np.ndarray, total: np.ndarray, number: np.ndarray) -> None:
            nonlocal open_
            left, new = total - gone, number - kinds
            escapes = (left > 0) & (number < 256)
            whole = np.where(left > 0, left + np.where(escapes, new, 0), 1)
            hit = open_ & (n > 0)
            out[hit] = paid[hit] + np.log10(n[hit] / whole[hit])
            open_ = open_ & ~hit
            pay = open_ & escapes
            paid[pay] += np.log10(new[pay] / whole[pay])

        sums = lambda size: np.unique(grams & ((1 << 8 * size) - 1), return_inverse=True)
        nodes, of = sums(order + 1)
        n = np.bincount(of, counts, minlength=len(nodes))
        for k in range(order, 2, -1):
            contexts, context = np.unique(nodes >> 8, return_inverse=True)
            number = np.bincount(context, n > 0, minlength=len(contexts))
            level(n[of], np.bincount(context, n, minlength=len(contexts))[context[of]], number[context[of]])
            if k > 3:
                below, below_of = sums(k)
                m = np.bincount(below_of, counts, minlength=len(below))
                shorter = m[np.searchsorted(below, nodes & ((1 << 8 * k) - 1))]
            else:
                below = below_of = m = None
                shorter = self.count(nodes & 0xFFFFFF)
            gone = np.bincount(context, np.where(n > 0, shorter, 0), minlength=len(contexts))[context[of]]
            kinds = number[context[of]]
            nodes, of, n = below, below_of, m
        row = self.row[grams >> 8 & 0xFFFF]
        total, number = self.total[row], self.distinct[row]
        level(self.count(grams & 0xFFFFFF), total, number)
        # below order 2 nothing depends on longer contexts: its length there, less the escape it holds
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where((total > 0) & (number < 256), np.log10(number / (total + number)), 0)
        return np.where(open_, paid + self.lengths[row, grams & 255] - escape, out)


def _raw(texts: pa.Array) -> list[bytes]:
    return [(t or b"").lower() for t in texts.cast(pa.binary()).to_pylist()]


def train(docs: DataFrame) -> Trie:
    """The trie, up to order 2, of the documents in (held_out, text) that are not held out.

    Workers count trigrams of symbols; at most 256 ** 3 sums reach the driver, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros(1 << 24, dtype=np.int64)
        for batch in batches:
            for part in blocks(batch.filter(pc.invert(batch.column(0))), 1, BLOCK_BYTES):
                np.add.at(grams, symbols(_raw(part.column(1)))[0], 1)
        some = np.flatnonzero(grams)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(grams[some], pa.int64())], ["code", "n"])

    got = docs.select("held_out", "text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    return Trie(got["code"].to_numpy(), got["n"].to_numpy())


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-cased words of the texts, and how many each text has."""
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower reads wrong bytes of some slices of a longer array
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    flat, size = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)  # leading or trailing blanks leave an empty one
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    ends = np.cumsum(size)
    return flat.filter(real), kept[ends] - kept[ends - size]


BLOCK = "block long, kind string, trained long, bucket int, keys binary, counts binary"


def _filled(batches: Iterator[pa.RecordBatch], column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about so many bytes in a text column, however small or large they come."""
    held, has = [], 0
    for batch in batches:
        for part in blocks(batch, column, size):
            held.append(part)
            has += pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if has >= size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, has = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tell_blocks(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """Documents, words and grams of each block of (doc_id, held_out, text).

    One row of kind ``documents`` a block, with its number of training documents and all its rows packed;
    and of kinds ``words`` and ``grams`` a row a bucket, with the distinct ones in order and how often the
    block's training documents have each.
    """

    def rows(block: int, kind: str, bucket: list, keys: list, counts: list, trained: int | None = None) -> pa.RecordBatch:
        n = len(keys)
        columns = [([block] * n, pa.int64()), ([kind] * n, pa.string()), ([trained] * n, pa.int64()), (bucket, pa.int32()), (keys, pa.binary()), (counts, pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 24
        for part in _filled(batches, 2, WORDS_BYTES):
            learn = ~part.column(1).to_numpy(zero_copy_only=False)
            told = pa.BufferOutputStream()
            with pa.ipc.new_stream(told, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield rows(block, "documents", [None], [told.getvalue().to_pybytes()], [None], int(learn.sum()))
            flat, size = _split(part.column(2))
            words, bucket, where = distinct_words(flat, buckets)
            n = _times(where, np.repeat(learn, size), len(words))
            own = [(bucket[a], zstandard.compress(b" ".join(words[a:b]), 3), pack(n[a:b])) for a, b in _runs(bucket)]
            if own:
                yield rows(block, "words", *map(list, zip(*own, strict=True)))
            del flat, words, where
            found, bucket, where, size = distinct(_raw(part.column(2)), order, buckets)
            n = _times(where, np.repeat(learn, size), len(found))
            del where
            own = [(bucket[a], pack(np.diff(found[a:b], prepend=0)), pack(n[a:b])) for a, b in _runs(bucket)]
            yield rows(block, "grams", *map(list, zip(*own, strict=True)))
            block += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, BLOCK)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    return list(itertools.pairwise([0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)])) if len(x) else []


VALUES = "of long, kind string, bucket int, values binary"


def _values(of: pa.ChunkedArray, kind: str, bucket: pa.ChunkedArray, each: list[np.ndarray], **more: list) -> pa.Table:
    n = len(each)
    return pa.table({"of": of, "kind": pa.array([kind] * n, pa.string()), "bucket": bucket, "values": pa.array([pack(x) for x in each], pa.binary())} | more)


def _listed(packed: bytes) -> pa.Array:
    """Words that were joined by spaces, without an object a word."""
    data = np.frombuffer(zstandard.decompress(packed), np.uint8)
    gaps = np.flatnonzero(data == 32)
    offsets = np.concatenate(([0], gaps - np.arange(len(gaps)), [len(data) - len(gaps)])).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 32].tobytes())])


def _joined(words: pa.Array) -> bytes:
    """The words joined by spaces and packed."""
    one = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()))
    return zstandard.compress(pc.binary_join(one, b" ")[0].as_buffer(), 3)


def word_sums(told: DataFrame, groups: int) -> DataFrame:
    """A row a bucket: its distinct words of the whole corpus with their counts (64-bit), their sum (``total``) and how many are over 0 (``kinds``).

    Words are summed by bucket and group of blocks first, so a word that all blocks have comes to a bucket once a group.
    """

    def summed(rows: pa.Table, kind: str) -> dict:
        coded = pa.concat_arrays([_listed(x.as_py()) for x in rows["keys"]]).dictionary_encode()
        n = np.concatenate([unpack(x.as_py(), kind) for x in rows["counts"]])
        c = np.bincount(coded.indices.to_numpy(), n, minlength=len(coded.dictionary)).astype("<i8")
        return {"bucket": rows["bucket"][:1], "keys": pa.array([_joined(coded.dictionary)], pa.binary()), "counts": pa.array([pack(c)], pa.binary()), "total": pa.array([int(c.sum())]), "kinds": pa.array([int((c > 0).sum())])}

    of_part = lambda rows: pa.table(summed(rows, "<u4")).select(["bucket", "keys", "counts"])
    of_bucket = lambda rows: pa.table(summed(rows, "<i8"))
    parts = _grouped(told, "words", groups).groupBy("bucket", "part").applyInArrow(of_part, "bucket int, keys binary, counts binary")
    return parts.groupBy("bucket").applyInArrow(of_bucket, "bucket int, keys binary, counts binary, total long, kinds long")


def _grouped(told: DataFrame, kind: str, groups: int) -> DataFrame:
    return told.filter(F.col("kind") == kind).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))


def _copied(model: DataFrame, groups: int, *columns: str) -> DataFrame:
    """A model's buckets, one for each group of blocks."""
    return model.select(F.col("bucket").alias("of"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *columns)


def word_counts(told: DataFrame, sums: DataFrame, groups: int) -> DataFrame:
    """Corpus-wide counts (64-bit) of each block's words of a bucket, in their order."""

    def look_up(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not rows.num_rows:  # no block of the group has a word of the bucket
            return _values(rows["block"], "words", rows["bucket"], [])
        known = _listed(model["keys"][0].as_py())
        c = unpack(model["counts"][0].as_py(), "<i8")
        each = [_listed(x.as_py()) for x in rows["keys"]]
        at = pc.index_in(pa.concat_arrays(each), value_set=known).to_numpy(zero_copy_only=False)
        return _values(rows["block"], "words", rows["bucket"], np.split(c[at], np.cumsum([len(x) for x in each])[:-1]))

    words = _grouped(told, "words", groups).select("block", "bucket", "part", "keys")
    return words.groupBy("bucket", "part").cogroup(_copied(sums, groups, "keys", "counts").groupBy("of", "group")).applyInArrow(look_up, VALUES)


def gram_lengths(told: DataFrame, trie: Trie, order: int, groups: int) -> DataFrame:
    """log10 probabilities (32-bit floats) of each block's grams of a bucket."""
    shared = told.sparkSession.sparkContext.broadcast(trie)
    grams = _grouped(told, "grams", groups)

    def summed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        found, where = np.unique(np.concatenate([np.cumsum(unpack(x.as_py(), "<i8")) for x in rows["keys"]]), return_inverse=True)
        n = np.concatenate([unpack(x.as_py(), "<i8" if rows.schema.get_field_index("block") < 0 else "<u4") for x in rows["counts"]])
        return found, np.bincount(where, n, minlength=len(found))

    def of_part(rows: pa.Table) -> pa.Table:
        found, n = summed(rows)
        return pa.table({"bucket": rows["bucket"][:1], "keys": [pack(np.diff(found, prepend=0))], "counts": [pack(n.astype("<i8"))]})

    def of_bucket(rows: pa.Table) -> pa.Table:
        found, n = summed(rows)
        codes = turned(found, order, back=True)
        sort = np.argsort(codes)
        lengths = np.empty(len(found), dtype="<f4")
        lengths[sort] = shared.value.predict(codes[sort], n[sort], order)
        return pa.table({"bucket": rows["bucket"][:1], "keys": [pack(np.diff(found, prepend=0))], "lengths": [pack(lengths)]})

    def look_up(rows: pa.Table, model: pa.Table) -> pa.Table:
        found, lengths = np.cumsum(unpack(model["keys"][0].as_py(), "<i8")), unpack(model["lengths"][0].as_py(), "<f4")
        each = (np.cumsum(unpack(x.as_py(), "<i8")) for x in rows["keys"])
        return _values(rows["block"], "grams", rows["bucket"], [lengths[np.searchsorted(found, x)] for x in each])

    parts = grams.groupBy("bucket", "part").applyInArrow(of_part, "bucket int, keys binary, counts binary")
    model = parts.groupBy("bucket").applyInArrow(of_bucket, "bucket int, keys binary, lengths binary")
    copied = _copied(model, groups, "keys", "lengths").groupBy("of", "group")
    return grams.select("block", "bucket", "part", "keys").groupBy("bucket", "part").cogroup(copied).applyInArrow(look_up, VALUES)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 1, order: int = 2) -> DataFrame:
    """One row a row of docs with its log10 probability under both models.

    Both learn from the documents whose id has another checksum remainder than ``held``; ``order``
    is the longest context's number of bytes, from 2 to 6. A null text is an empty one, of which the end
    is left; a null id counts as an empty text. Without training documents all counts are 0. Case of
    ASCII letters makes no difference. A text is one row of a block, however long.
    """
    if not 2 <= order <= 6:
        raise ValueError(f"order {order}: from 2 to 6")
    d = docs.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key), modulus) == held).alias("held_out"), F.col(text).cast("string").alias("text"))
    trie = train(d)
    trained = int(trie.counts.sum())
    buckets, groups = BUCKETS + trained // BUCKET_BYTES, 1 + trained // (WORDS_BYTES * GROUP_BLOCKS)
    told = materialize(tell_blocks(d, order, buckets), "blocks")
    counted = materialize(word_sums(told, groups), "counts")
    known = word_counts(told, counted, groups).unionByName(gram_lengths(told, trie, order, groups))
    total, kinds = (x or 0 for x in counted.agg(F.sum("total"), F.sum("kinds")).first())
    ends = told.agg(F.sum("trained")).first()[0] or 0
    total, kinds = total + ends, kinds + (ends > 0)
    rest = np.log10(total + 0.5 * (kinds + 1))

    def run(documents: pa.Table, known: pa.Table) -> pa.Table:
        part = pa.ipc.open_stream(documents["keys"][0].as_buffer()).read_next_batch()
        texts, known = part.column(2), known.sort_by("bucket")
        of = lambda kind, t: np.concatenate([np.empty(0, t), *(unpack(x.as_py(), t) for x in known.filter(pc.equal(known["kind"], kind))["values"])])
        flat, size = _split(texts)
        c = of("words", "<i8")[distinct_words(flat, buckets)[2]]  # in the order of tell_blocks
        edges = np.cumsum(size) - size
        sums, hits = (np.where(size > 0, np.add.reduceat(np.append(x, 0), edges), 0) for x in (np.log10(c + 0.5) - rest, (c > 0).astype(np.int64)))
        del flat, c
        _, _, where, grams_of = distinct(_raw(texts), order, buckets)
        scores = np.add.reduceat(of("grams", "<f4")[where], np.cumsum(grams_of) - grams_of, dtype=np.float64)
        out = [part.column(0), part.column(1), *(pa.array(x, t) for x, t in ((size + 1, pa.int64()), (hits + int(ends > 0), pa.int64()), (sums + np.log10(ends + 0.5) - rest, pa.float64()), (scores, pa.float64())))]
        return pa.table(out, names=[x.split()[0] for x in SCORES.split(", ")])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + trained // TASK_BYTES)
    documents = told.filter("kind = 'documents'").select("block", "keys").repartition(parts, "block")
    scored = documents.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, SCORES)
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))
