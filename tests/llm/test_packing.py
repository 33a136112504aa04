import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tidewire.llm import packing
from tidewire.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs):
    """rows against brute force: every id once, sequences gapless and within the capacity."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = {k: np.array([*t.encode(v or "", add_special_tokens=False).ids, 0], "<u4") for k, v in docs.items()}
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for k, part in by_doc.items():
        at = 0
        for r in sorted(part, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[k][r.start : at].tobytes())
        assert at == len(ids[k])
    padding = 0
    for part in by_seq.values():
        at = 0
        for r in sorted(part, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, sum(map(len, ids.values()))


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    padding, total = check(packing.pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding < 0.02 * total


def test_edges(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "word " * 9000, 9), (4, "a  b\n\n c <|endoftext|>  x", 9), (None, "null key", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    got = packing.pack(df, PATH).collect()
    check([r for r in got if r.doc_id is not None], {k: v for k, v, _ in rows if k})
    assert [r.doc_id for r in got if r.doc_id is None]
    twice = packing.pack(df.union(df).coalesce(1), PATH).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in got)
    assert packing.pack(df.limit(0), PATH).count() == 0
    assert {r.ids for r in packing.pack(df.filter("doc_id = 2"), PATH, with_ids=True).collect()} == {b"\0\0\0\0"}


def test_harmonic_classes():
    bins = packing.Bins(1024, 0)
    placed = [x for i in range(8) for x in bins.add(i, 128)]
    assert [p[1:] for p in placed] == [(0, 128 * i) for i in range(8)] and not bins.open
    assert packing.pieces(1900) == [(0, 1024), (1024, 512), (1536, 256), (1792, 108)]


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_tokenizer(seed):
    r = random.Random(seed)
    parts = [" ", "  ", "\n", "a", "b1", "é", "'s", " ", "!", "12", "\t", " \n", "<|endoftext|>", "日本", "Ġ", " ", "word"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(500)]
    e = Encoder.shared(PATH)
    for text, got in zip(texts, e.encode_all(pa.array(texts)), strict=True):
        assert np.array_equal(got, e.encode(text)), repr(text)
