import numpy as np
from tidewire.llm import langid


def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.Net(["a", "b", "c"], hidden=4)
    for p in (net.forward, net.backward):
        p.table, p.u = p.table.astype(np.float64), p.u.astype(np.float64)
    data, label = rng.integers(97, 105, (5, 7)), np.array([0, 1, 2, 1, 0])
    mask = np.ones(data.shape, dtype=bool)
    _, grads = net.gradients(data, label, mask)
    for p, g in zip(net.parameters(), grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was, eps = p[at], 1e-2
        p[at] = was + eps
        up = net.gradients(data, label, mask)[0]
        p[at] = was - eps
        down = net.gradients(data, label, mask)[0]
        p[at] = was
        assert abs((up - down) / (2 * eps) - g[at]) < 1e-3 + 0.02 * abs(g[at])


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in langid.predict(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_windows_cover_whole_texts():
    net = langid.Net(["a", "b"], hidden=4)
    long = b"abc" * 5000
    whole = net.probabilities([long, b"x", long])
    assert np.allclose(whole[0], whole[2]) and np.allclose(whole.sum(axis=1), 1)


def test_edges(spark):
    rows = [(1, "le la les", "fr", 1.0), (3, "the of and", "en", 1.0), (4, None, "en", 1.0), (5, "12 !?", None, 1.0), (None, "the", "en", 1.0), (7, "", "en", 1.0), (3, "the of and", "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = langid.predict(df).collect()
    assert len(got) == 7 and {r.lang_pred for r in got} <= {"fr", "en", "und"}
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (4, 5, 7)] == [("und", 0.0)] * 3
    assert langid.predict(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(df.filter("doc_id = 5")).collect()} == {"und"}


def test_pooling_against_both_layers_states():
    rng = np.random.default_rng(5)
    net = langid.Net(["a", "b", "c"], hidden=4)
    data = rng.integers(32, 123, (6, 20)).astype(np.uint8)
    logits = net._states(data)[2] @ net.w + net.b
    logs = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
    letters = ~langid._SPACES[data]
    total, n = net.pooled(data)
    assert np.allclose(total, (logs * letters[:, :, None]).sum(axis=1), atol=1e-3) and (n == letters.sum(axis=1)).all()
