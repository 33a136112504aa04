import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tidewire.llm import ppm


def by_hand(texts, text):
    """log10 probability by walking the contexts symbol by symbol."""
    follow = {}
    syms = lambda t: [ppm.START, ppm.START, *t.encode().lower(), ppm.END]
    for t in texts:
        s = syms(t)
        for i in range(2, len(s)):
            for c in ((s[i - 2], s[i - 1]), (s[i - 1],), ()):
                follow.setdefault(c, Counter())[s[i]] += 1
    out, s = 0.0, syms(text)
    for i in range(2, len(s)):
        excluded = set()
        for c in ((s[i - 2], s[i - 1]), (s[i - 1],), ()):
            n = {k: v for k, v in follow.get(c, {}).items() if k not in excluded}
            if not n:
                continue
            whole = sum(n.values()) + (len(n) if len(n) + len(excluded) < 256 else 0)
            if s[i] in n:
                out += math.log10(n[s[i]] / whole)
                break
            out += math.log10(len(n) / whole)
            excluded |= set(n)
        else:
            out -= math.log10(256 - len(excluded))
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, block int")
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.score) for r in ppm.score(df).collect()))
    known = {r.doc_id: r for r in ppm.score(df).collect()}
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    train = [t or "" for k, t in rows if not held(k)]
    c = Counter(w for t in train for w in [*t.encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for k, t in rows:
        w = [*(t or "").encode().lower().split(), b" "]
        r = known[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(k), len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert r.score == pytest.approx(by_hand(train, t or ""), rel=1e-4)


def test_against_brute_force(spark):
    rows = [(i, " ".join(["The", "cat", "SAT", "é", "on", "a\tmat"][j % 6] + "x" * (i * j % 3) for j in range(i % 17))) for i in range(60)]
    check(spark, [*rows, (100, None), (101, ""), (102, "  lead and trail \n"), (None, "no id")])


def test_repeated_empty_and_untrained(spark):
    df = spark.createDataFrame([(6, "x y"), (6, "x y")], "doc_id long, text string")
    assert len(ppm.score(df).collect()) == 2 and ppm.score(df.limit(0)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).collect()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(-3 * math.log10(256), rel=1e-5)


def test_rows_are_distributions():
    codes = np.random.default_rng(0).integers(0, 1 << 24, 4000)
    trie = ppm.Trie(codes, np.ones(len(codes)))
    assert np.allclose((10.0 ** trie.lengths.astype(float)).sum(axis=1), 1, atol=1e-4)


def test_learns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = {r.doc_id: len(r.text.encode()) + 1 for r in docs.collect()}
    rows = [r for r in ppm.score(docs).collect() if r.held_out]
    bits = -sum(r.score for r in rows) / math.log10(2) / sum(size[r.doc_id] for r in rows)
    assert 1 < bits < 3
