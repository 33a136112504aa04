import random

import pyarrow as pa
from tidewire.llm import components, ngram_join


def grams(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, threshold=0.8):
    sets = [grams(t) for _, t in rows]
    near = lambda a, b: len(a & b) >= threshold * len(a | b) - 1e-9 if a and b else False
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, js in enumerate(links):
            low = min([label[i], *(label[j] for j in js)])
            for j in [i, *js]:
                changed |= label[j] != low
                label[j] = low
    least = {}
    for (k, _), x in zip(rows, label, strict=True):
        if k is not None:
            least[x] = min(k, least.get(x, k))
    return sorted((str(k), least.get(x), len(js)) for (k, _), x, js in zip(rows, label, links, strict=True))


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, m int")
    return sorted((str(r.doc_id), r.class_id, r.n_links) for r in ngram_join.join(df, **more).collect())


def made(seed, groups=12, size=8):
    r = random.Random(seed)
    rows, k = [], 0
    for g in range(groups):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([30, 80, 200]))]
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randint(0, 99)}"
            rows.append((k, "  ".join(w) if g % 3 else " ".join(w)))
            k += 1
    return rows


def test_against_brute_force(spark):
    rows = [*made(1), (900, None), (901, ""), (902, " \n "), (903, "a b c"), (904, "a b  c"), (905, "a b d"), (None, "a b c"), (903, "a b c"), (906, "z " * 30000)]
    assert got(spark, rows) == brute(rows)


def test_large_groups_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BUCKET_CHUNK", 8)
    monkeypatch.setattr(ngram_join, "CLUSTER_CHUNK", 5)
    rows = made(2, groups=3, size=60)
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df).count() == 0


def test_bands():
    for t in (0.5, 0.8, 0.9):
        bands, rows = ngram_join.bands_for(t, 0.999, 512)
        assert bands * rows <= 512 and 1 - (1 - t**rows) ** bands >= 0.999


def test_grams_do_not_cross_documents():
    a = ngram_join.gram_sets(pa.array(["a b c d e f", "g", None, "a b c d e"]))
    assert [len(x) for x in a] == [2, 1, 0, 1] and a[3][0] in a[0]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            label[b] = a
    assert got == {x: find(x) for x in label}
