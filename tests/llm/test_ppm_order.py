import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tidewire.llm import ppm, queries


def by_hand(train, text, order):
    """log10 probability by walking the contexts symbol by symbol, from the longest."""
    follow = {}
    syms = lambda t: [ppm.START] * order + [*t.encode().lower(), ppm.END]
    for t in train:
        s = syms(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                follow.setdefault(tuple(s[i - k : i]), Counter())[s[i]] += 1
    out, s = 0.0, syms(text)
    for i in range(order, len(s)):
        excluded = set()
        for k in range(order, -1, -1):
            n = {x: v for x, v in follow.get(tuple(s[i - k : i]), {}).items() if x not in excluded}
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


def test_the_query_uses_contexts_of_five_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ppm, "WORDS_BYTES", 300)  # many blocks, whose counts must meet
    monkeypatch.setattr(ppm, "GROUP_BLOCKS", 4)  # in several groups
    words = ["The", "thesis", "SAT", "é", "there", "a\tmat", "other", "then"]
    texts = [" ".join(words[(j * j + i * j) % 8] + "x" * (i * j % 3) for j in range(i % 23)) for i in range(80)]
    spark.createDataFrame(list(enumerate([*texts, None, "", "zzz the theses"])), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    rows = [*enumerate([*texts, "", "", "zzz the theses"])]
    train = [t for k, t in rows if not held(k)]
    got = {r.doc_id: r for r in queries.op10_ppm_score(spark, str(tmp_path)).collect()}
    for k, t in rows:
        assert got[k].score == pytest.approx(by_hand(train, t, 5), rel=1e-4)
        assert got[k].n_tokens == len(t.encode().split()) + 1


def test_every_order_is_a_distribution():
    """All 256 symbols after a context, seen or not, add up to 1, also where it has been followed by all of them."""
    rng = np.random.default_rng(0)
    for order in (2, 3, 5):
        raw = [rng.integers(97, 101, 400, dtype=np.uint8).tobytes(), bytes(x for y in range(254) for x in (*b"abcab", y))]
        codes, n = np.unique(ppm.symbols(raw, order)[0], return_counts=True)
        trie = ppm.Trie(*np.unique(ppm.symbols(raw)[0], return_counts=True))
        for context in (b"abcab", b"cabca", b"qqabc", b"qqqab", b"qqqqq"):
            head = int.from_bytes(context[-order:], "big") << 8
            every = np.union1d(codes, head + np.arange(256))
            counts = np.zeros(len(every))
            counts[np.searchsorted(every, codes)] = n
            got = trie.predict(every, counts, order)[np.searchsorted(every, head + np.arange(256))]
            assert (10**got).sum() == pytest.approx(1, abs=1e-5)
