import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa
from tidewire.llm import queries, secret_scan


def base(text):
    """The contract's base spans by plain search."""
    out = []
    for k, (kind, p, g, least) in enumerate((
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", r"AKIA[A-Z0-9]+", 0, 16),
        ("hex", r"[0-9a-f]+", 0, 32),
    )):
        flags = re.ASCII | (re.IGNORECASE if kind == "assign" else 0)
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, text, flags) if len(m[g]) >= least]
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


PARTS = ["password", "PassWd", "secret", "api_key", "APIKEY", "tok", "en", "\"", "'", " ", ":", "=", "abcdef0123", "AKIA", "ABCDEFGH12", "é", "日本", "deadbeef" * 4, "x" * 9, "\n", "ghp_" + "a1" * 20]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=6))
def test_base_spans(texts):
    for text, got in zip(texts, secret_scan.scanner().scan(pa.array(texts)), strict=True):
        assert [s for s in got if s[0] in secret_scan.BASE] == base(text), repr(text)


def test_queries_of_rules():
    q = {r.kind: secret_scan.query(r.pattern) for r in secret_scan.RULES}
    assert q["hex"] == [] and q["access"] == [[frozenset({"aki", "kia"})]]
    assert frozenset({"tok", "oke", "ken"}) in q["assign"][0] and len(q["private_key"]) == 2
    assert all(q[k] for k in q if k != "hex")


def test_slices_and_nulls():
    texts = pa.array(["deadbeef" * 3, "deadbeef", None, "", "token=abcdefgh"])
    assert secret_scan.scanner().scan(texts.slice(1)) == [[], [], [], [("assign", 0, 14)]]


def test_whole_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op9_secret_index(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = base(r.text or "")
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert got[r.doc_id].n_assign == sum(k == "assign" for k, _, _ in want)
        assert got[r.doc_id].n_hex == sum(k == "hex" for k, _, _ in want)


def test_redact_and_edges(spark):
    long = "x " * 200000 + "AKIA" + "B" * 16
    df = spark.createDataFrame([(1, "a token = \"abcdefgh12\" b", 5, "k"), (None, None, None, "k"), (2, long, 7, "k"), (2, long, 7, "k")], "doc_id long, text string, n_chars long, spans string")
    got = secret_scan.redact(df).collect()
    assert got[0].text == "a [SECRET]\" b" and got[0].n_chars == len(got[0].text) and got[0].spans == "k"
    assert got[1].text is None and got[2].text.endswith("x [SECRET]") and got[2] == got[3]
    assert [len(r.spans) for r in secret_scan.find_secrets(df).collect()] == [1, 0, 1, 1]
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_all_kinds_against_plain_search():
    """Every rule tried on every text, without the index, gives the same spans: those of the added kinds too."""
    rng = random.Random(9)
    word = lambda k, chars="abcXYZ019_-": "".join(rng.choice(chars) for _ in range(k))
    made = [
        lambda: "-----BEGIN RSA PRIVATE KEY-----", lambda: "-----BEGIN PRIVATE KEY----", lambda: f"gh{rng.choice('pousrx')}_{word(rng.randrange(30, 45), 'abXY01')}", lambda: f"xox{rng.choice('abprsz')}-{word(rng.randrange(5, 20), 'ab01-')}",
        lambda: f"eyJ{word(rng.randrange(6, 12))}.eyJ{word(rng.randrange(6, 12))}.{word(rng.randrange(6, 12))}", lambda: f"AIza{word(rng.randrange(30, 40))}", lambda: f"{rng.choice('srp')}k_live_{word(rng.randrange(10, 20), 'abXY01')}",
        lambda: f"https://{word(3, 'abc')}:{word(4, 'abc1')}@host", lambda: f"PassWord = '{word(rng.randrange(5, 12))}'", lambda: f"AKIA{word(rng.randrange(8, 18), 'AB01')}", lambda: word(rng.randrange(28, 36), "0af"), lambda: word(5, "é x"), lambda: "eyJ eyJ", lambda: "",
    ]
    texts = [rng.choice(["", " ", "\n"]).join(rng.choice(made)() for _ in range(rng.randrange(6))) for _ in range(500)] + [None]
    got = secret_scan.Scanner().scan(pa.array(texts))
    kinds = set()
    for text, spans in zip(texts, got, strict=True):
        want = []
        for order, r in enumerate(secret_scan.RULES):
            want += [(m.start(), order, r.kind, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII) if m.end(r.group) - m.start(r.group) >= r.least]
        assert spans == [(k, a, b) for a, _, k, b in sorted(want)], text
        kinds |= {k for k, _, _ in spans}
    assert kinds == {r.kind for r in secret_scan.RULES}
