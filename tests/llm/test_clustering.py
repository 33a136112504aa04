import hashlib
import random

from tidewire.llm import clustering

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def brute(rows, k, rounds, scale=64):
    """Full scans over Python integers."""
    kept = [(i, [int(x * scale // 1) for x in v]) for i, v in rows]
    named = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in named[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (far(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == c]
            centroids[c] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    own = [nearest(v) for _, v in kept]
    return sorted(((i, c, far(v, centroids[c])) for (i, v), c in zip(kept, own, strict=True)), key=str), centroids


def made(n, seed, width=6, grid=None):
    rng = random.Random(seed)
    heads = [[rng.gauss(0, 3) for _ in range(width)] for _ in range(5)]
    point = lambda: [h + rng.gauss(0, 1) for h in rng.choice(heads)]
    return [(i, [round(x * grid) / grid for x in point()] if grid else point()) for i in range(n)]


def run(spark, rows, k, rounds, width=6):
    table = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], SCHEMA).repartition(3)
    out, centroids = clustering.cluster(clustering.vectors(table, width=width), k, rounds)
    got = out.collect()
    return sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=str), [c.tolist() for c in centroids], got


def test_as_full_scans(spark):
    for rows, k in ((made(600, 1), 7), (made(300, 2, grid=1), 9), (made(4, 3), 7), ([(1, [0.5] * 6)] * 5 + [(None, [0.5] * 6), (2, [-0.5] * 6)], 4)):
        got, centroids, _ = run(spark, rows, k, 3)
        want, heads = brute(rows, k, 3)
        assert got == want and centroids == heads


def test_bounds_save_scans(spark):
    rows = made(800, 4)
    got, _, all_ = run(spark, rows, 5, 6)
    assert got == brute(rows, 5, 6)[0]
    assert sum(r.scans for r in all_) < 0.6 * 7 * len(rows)  # without bounds every vector is scanned in each of 7 assignments


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, []), (3, [1.0] * 5), (4, [None] + [1.0] * 5), (5, [nan] + [1.0] * 5), (6, [inf] + [1.0] * 5), (7, [1e20] * 6)]
    assert run(spark, bad, 4, 3)[0] == []
    good = [(8, [-2_000_000.0] * 6), (9, [2_000_000.0] * 6), (9, [2_000_000.0] * 6)]
    assert run(spark, bad + good, 2, 3)[0] == brute(good, 2, 3)[0]


def test_described(spark):
    rows = made(100, 5)
    table = spark.createDataFrame([(i, v, "own", 1) for i, v in rows], SCHEMA)
    out, centroids = clustering.cluster(clustering.vectors(table, width=6), 4, 2)
    got = clustering.described(out, centroids).collect()
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster].tolist())).encode()).hexdigest()
    empty = clustering.described(*clustering.cluster(clustering.vectors(table.limit(0), width=6)))
    assert empty.collect() == [] and empty.columns == clustering.described(out, centroids).columns
