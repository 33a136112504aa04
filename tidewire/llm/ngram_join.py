"""Self-join of documents on the Jaccard similarity of their word n-grams, by MinHash bands.

Texts with the same set of n-grams are one class from the start, so exact copies cost one row
each and are never paired. Every class has a MinHash signature; bands of it are shuffled by their
hash. Numbers of bands and rows follow from the threshold and a target recall. Within a bucket,
one byte of each MinHash value tells pairs that cannot be similar from those that may be; the
latter connect classes into clusters, of which only a spanning forest is emitted. Within a
cluster all pairs are verified on the full n-gram sets.

Large buckets and clusters are dealt out as pairs of chunks of bounded size, so no task holds
one whole and no pairs are emitted as rows: a task returns counts of links and a spanning
forest of the verified ones, whose components are the classes of the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components
from .tokens import blocks

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Values a signature may have at most.
MOST_HASHES = 128
#: Classes a chunk of a bucket, and of a cluster.
BUCKET_CHUNK, CLUSTER_CHUNK = 1024, 96
#: Standard deviations below the threshold at which a signature still counts as possibly similar.
SLACK = 5
#: Parts of a component when its nodes are joined with what is known of it.
SALTS = 32
BLOCK_BYTES = 4 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, for the recall at the threshold within so many hashes."""
    best = None
    for rows in range(1, most + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("no bands reach this recall within so many hashes")
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_sets(texts: pa.Array, n: int = NGRAM) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct word n-grams; of fewer words than n, all of them are one gram."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    flat, length = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    edges = kept[np.concatenate(([0], np.cumsum(length)))]
    coded = flat.filter(real).dictionary_encode()
    names = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    h = names[coded.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.uint64)
    grams = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        grams = grams * _P + h[k : k + len(grams)]
    grams = _mix(grams)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for k in range(a, b):
                x = x * _P + h[k : k + 1]
            out.append(_mix(x))
        else:
            out.append(np.empty(0, np.uint64))
    return out


class Signer:
    def __init__(self, bands: int, rows: int):
        r = np.random.default_rng(7)
        self.bands, self.rows = bands, rows
        self.a = r.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def sign(self, grams: np.ndarray) -> np.ndarray:
        """The least value of each hash function over the set."""
        out = np.full(len(self.a), 0xFFFFFFFF, dtype=np.uint64)
        for at in range(0, len(grams), 1024):
            out = np.minimum(out, ((grams[at : at + 1024, None] * self.a + self.b) >> np.uint64(32)).min(axis=0))
        return out

    def buckets(self, signature: np.ndarray) -> np.ndarray:
        x = np.arange(1, self.bands + 1, dtype=np.uint64)
        for column in signature.reshape(self.bands, self.rows).T:
            x = _mix(x * _P + column)
        return x.view(np.int64)


def _key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def signed(docs: DataFrame, n: int, bands: int, rows: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of (doc_id, text, ...): the key of its n-gram set, the hashes of its bands, one byte a MinHash value, and the columns ``carried``."""
    signer, at = Signer(bands, rows), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, at, BLOCK_BYTES):
                sets, known, out = gram_sets(block.column(at), n), {}, []
                for grams in sets:
                    key = _key(grams)
                    if key is not None and key not in known:
                        s = signer.sign(grams)
                        known[key] = signer.buckets(s), (s & np.uint64(255)).astype(np.uint8).tobytes()
                    out.append((key, *known.get(key, (None, None))))
                keys, hashes, small = zip(*out, strict=True)
                told = [pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(small, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(block.column(c) for c in names), *told], [*names, "key", "buckets", "small"])

    names = ["doc_id", *carried]
    schema = T.StructType([docs.schema[c] for c in names])
    return docs.mapInArrow(run, schema.add("key", T.BinaryType()).add("buckets", T.ArrayType(T.LongType())).add("small", T.BinaryType()))


def _dealt(rows: DataFrame, group: str, count: str, chunk: int) -> DataFrame:
    """rows (with ``id``, their group and its row count) copied to each pair of chunks (i, j) of their group; ``own`` is their chunk."""
    chunks = F.ceil(F.col(count) / chunk).cast("int")
    own = F.when(chunks > 1, F.pmod(F.xxhash64("id"), chunks)).otherwise(0).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", count).repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def _by_component(nodes: DataFrame, told: DataFrame) -> DataFrame:
    """nodes (node, component) with what is told of their component; a component with many nodes is split by a salt, of which ``told`` has a copy each."""
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    copies = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["component", "salt"]).drop("salt")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows alike in the first ``keys`` long columns are never cut apart."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, dtype=bool)
        for k in range(keys):
            column = batch.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if held and not first:
            last = held[-1]
            if any(last.column(k)[-1] != batch.column(k)[0] for k in range(keys)):
                yield pa.Table.from_batches(held)
                held = []
        if first:
            yield pa.Table.from_batches([*held, batch.slice(0, first)])
            held = []
        held.append(batch.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _edges(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in range(keys):
        c = table.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation given as a matrix."""
    n, seen, out = len(similar), np.zeros(len(similar), dtype=bool), []
    for root in range(n):
        if seen[root]:
            continue
        seen[root], front = True, [root]
        while front:
            x = front.pop()
            new = np.flatnonzero(similar[x] & ~seen)
            seen[new] = True
            out += [(x, y) for y in new.tolist()]
            front += new.tolist()
    return out


def _maybe_similar(bands: int, rows: int, threshold: float) -> Callable:
    h = bands * rows
    low = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / h)
    least = math.ceil(h * (low + (1 - low) / 256))  # a byte also agrees by chance

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            ids = table["id"].to_numpy()
            small = np.frombuffer(b"".join(table["small"].to_pylist()), np.uint8).reshape(-1, h)
            next_ = (small[:-1] == small[1:]).sum(axis=1) >= least
            edges = _edges(table, 3)
            a, b = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo == 2:
                    pairs = [(0, 1)] if next_[lo] else []
                elif hi - lo > 2:
                    part = small[lo:hi]
                    similar = np.stack([(part == x).sum(axis=1) >= least for x in part])
                    pairs = _forest(similar)
                else:
                    continue
                a += [ids[lo + x] for x, _ in pairs]
                b += [ids[lo + y] for _, y in pairs]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections: a product over the grams that two sets or more hold."""
    flat = np.concatenate(sets)
    _, where, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.cumsum(times > 1) - 1
    keep = times[where] > 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    columns, owner = shared[where[keep]], owner[keep]
    order = np.argsort(columns, kind="stable")
    columns, owner = columns[order], owner[order]
    for lo in range(0, int(columns[-1]) + 1 if len(columns) else 0, 16384):
        a, b = np.searchsorted(columns, (lo, lo + 16384))
        m = np.zeros((len(sets), 16384), dtype=np.float32)
        m[owner[a:b], columns[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verified(n: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            ids, copies, own = (table[c].to_numpy() for c in ("id", "copies", "own"))
            edges, out = _edges(table, 3), []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                sets = gram_sets(pa.array([zstandard.decompress(t) for t in table["packed"].slice(lo, hi - lo).to_pylist()], pa.binary()).cast(pa.string()), n)
                size = np.array([len(s) for s in sets], dtype=np.float64)
                both = _intersections(sets).astype(np.float64)
                similar = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
                np.fill_diagonal(similar, False)
                mine = own[lo:hi]
                if mine.min() != mine.max():  # two chunks: each one's own pairs belong to another group
                    similar &= mine[:, None] != mine[None, :]
                links = similar @ copies[lo:hi]
                out += [(ids[lo + x], None, int(links[x])) for x in np.flatnonzero(links)]
                out += [(ids[lo + x], ids[lo + y], 0) for x, y in _forest(similar)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b", "links"])

    return run


def classes_of(d: DataFrame, n: int, threshold: float, recall: float, carried: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """For (doc_id, text, tie, ...): the written rows (row, doc_id, key, carried columns), and per key its class_id, n_links, copies, whether it is
    its class's one to keep, and its first row by doc_id (nulls last), then tie."""
    bands, rows = bands_for(threshold, recall)
    told = materialize(signed(d, n, bands, rows, ("tie", *carried)).withColumn("row", F.monotonically_increasing_id()), "signed")
    first_row = F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row")).alias("row")
    by_key = told.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("first"), first_row, F.count(F.lit(1)).alias("copies"), F.any_value("buckets").alias("buckets"), F.any_value("small").alias("small"))
    classes = materialize(by_key.withColumn("id", F.monotonically_increasing_id()), "classes")

    members = classes.select("id", F.explode("buckets").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    inside = members.join(crowded, "bucket").join(classes.select("id", "small"), "id")
    dealt = _dealt(inside.select("bucket", "id", "small", "m"), "bucket", "m", BUCKET_CHUNK)
    maybe = dealt.select("bucket", F.col("i").cast("long"), F.col("j").cast("long"), "id", "small").mapInArrow(_maybe_similar(bands, rows, threshold), "a long, b long")
    clusters = components(maybe, "clusters")
    sized = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    wanted = materialize(_by_component(clusters, sized).withColumnRenamed("node", "id").join(classes.select("id", "key", "copies"), "id"), "wanted")

    # the texts move at every size of the input, so that the plan at a small one says what a large one costs
    texts = keyed(d, n).join(wanted.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])
    dealt = _dealt(texts.join(wanted.hint("merge"), "key").select("component", "id", "copies", "packed", "m"), "component", "m", CLUSTER_CHUNK)
    columns = ["component", F.col("i").cast("long"), F.col("j").cast("long"), "id", "copies", "own", "packed"]
    found = materialize(dealt.select(*columns).mapInArrow(_verified(n, threshold), "a long, b long, links long"), "links")

    links = found.filter("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    named = components(found.filter("b IS NOT NULL").select("a", "b"), "linked")
    order = F.struct(F.col("first").isNull(), "first", "id")
    lowest = named.join(classes.select("id", "first"), F.col("node") == F.col("id")).groupBy("component").agg(F.min("first").alias("least"), F.min_by("id", order).alias("keeper"))
    linked = _by_component(named, lowest).select("node", "least", "keeper")
    all_ = classes.join(linked, F.col("id") == F.col("node"), "left").join(links, F.col("id") == F.col("a"), "left")
    return told, all_.select("key", F.coalesce("least", "first").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies", (F.coalesce("keeper", "id") == F.col("id")).alias("keep"), "row")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row a row of docs: doc_id, class_id, n_links, copies.

    class_id is the least doc_id of all documents that links connect it with, n_links the number
    of other rows whose n-gram sets have that Jaccard similarity or more with its own, copies
    (rows with the very same set) included. Links are exact; a pair at the threshold is
    found with the given recall, one above it more surely. Null, empty and blank texts have no
    n-grams: they link with nothing and are classes of their own. Null ids never name a class of
    others. Repeated rows are copies of each other.
    """
    text = F.col(text).cast("string")
    told, classes = classes_of(docs.select(F.col(key).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie")), n, threshold, recall)
    joined = told.select("doc_id", "key").join(classes.drop("keep", "row"), "key", "left")
    return joined.select("doc_id", F.coalesce("class_id", F.when(F.col("key").isNull(), F.col("doc_id"))).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))


def deduplicate(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class, that of the least doc_id, and with docs' own columns only. Rows without n-grams (null, empty or blank texts) all stay.

    A row with a null id stays only where its class has no other; of repeated rows one stays.

    The rows are written with their keys once; then only their numbers decide, so that they move once more, spread evenly whatever their copies.
    """
    rest = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.struct(*rest).alias("rest"))
    told, classes = classes_of(d, n, threshold, recall, ("text", "rest"))
    stay = materialize(classes.filter("keep").select("row"), "stay")
    # merged at every size of the input, so that the plan at a small one says what a large one costs
    kept = told.filter("key IS NOT NULL").join(stay.hint("merge"), "row", "left_semi")
    plain = told.filter("key IS NULL")
    columns = [F.col("text").cast(docs.schema["text"].dataType).alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns]
    return kept.select(*columns).unionByName(plain.select(*columns))


def keyed(docs: DataFrame, n: int = NGRAM) -> DataFrame:
    """(key, packed text) of (doc_id, text), a row a key and task: copies go before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for block in blocks(batch, 0, BLOCK_BYTES):
                keys, packed = [], []
                for i, grams in enumerate(gram_sets(block.column(0), n)):
                    key = _key(grams)
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        packed.append(zstandard.compress(block.column(0)[i].as_py().encode(), 1))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], ["key", "packed"])

    return docs.select("text").mapInArrow(run, "key binary, packed binary")
