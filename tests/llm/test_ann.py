import numpy as np
import pytest
from tidewire.llm import ann


def brute(rows, modulus, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for i, v in good:
        if i % modulus == 0:
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), j) for j, w in good if j != i and len(w) == len(v))
            out[i] = near[:k]
    return out


def run(spark, rows, modulus, k, **more):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, shard int")
    out = {}
    for r in ann.neighbours(df, modulus, k, **more).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_edges_and_ties(spark):
    rows = [(i, [float(i % 7), float(i % 3)]) for i in range(1, 60)]
    rows += [(100 + i, [5.0, 5.0]) for i in range(40)] + [(100, [5.0, 5.0])] * 3
    rows += [(200, None), (210, [None, 1.0]), (220, [float("nan"), 1.0]), (230, [0.0, 0.0]), (240, []), (250, [float("inf"), 0.0]), (None, [1.0, 1.0]), (300, [1.0, 2.0, 3.0])]
    got, want = run(spark, rows, 10, 5), brute(rows, 10, 5)
    want.pop(300)  # nothing else of its length
    assert got == {q: [(s, i) for s, i in w] for q, w in want.items()}


def test_recall_over_shards(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet").collect()]
    got, want = run(spark, rows, 20, 10, shard_rows=500), brute(rows, 20, 10)
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert set(got) == set(want) and hits >= 0.95 * sum(map(len, want.values()))


def test_empty(spark):
    df = spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>")
    assert ann.neighbours(df, 100, 10).count() == 0


def test_pruning_keeps_diverse_edges():
    g = ann.Graph(np.array([[0, 0], [1, 0], [1.1, 0], [1.2, 0], [0, 1], [-1, 0]]))
    assert set(g.prune(0, np.arange(6)).tolist()) == {1, 4, 5}


def test_magnitudes(spark):
    """Vectors of any finite magnitude, and clusters far from the origin, find all candidates in the order of double precision."""
    rng = np.random.default_rng(3)
    for scale, offset in ((1e20, 0), (1e-30, 0), (1, 1e7), (3e38, 0)):
        x = (rng.standard_normal((60, 8)).clip(-1, 1) * scale + offset).astype(np.float32)
        rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(100, [1e30] * 8), (200, [1.0] * 8)]
        got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 100, 10).collect()
        every = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in rows}
        for q in (0, 100, 200):
            want = sorted((float(np.sqrt(((v - every[q]) ** 2).sum())), i) for i, v in every.items() if i != q)[:10]
            assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(pytest.approx(s, rel=1e-12, abs=0), i) for s, i in want], (scale, q)


def test_copies_of_shards_answer_alike(spark, sf, monkeypatch):
    """Blocks of a few queries, and a copy of each shard for every other block, change nothing."""
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    run = lambda: sorted(tuple(r) for r in ann.neighbours(table, 10, 5, shard_rows=100).collect())
    want = run()
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    monkeypatch.setattr(ann, "COPY_BLOCKS", 2)
    assert run() == want and len(want) > 0
