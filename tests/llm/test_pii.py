import hashlib
import random
import re

from tidewire.llm import pii, queries


def luhn(d):
    return sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base(text):
    return [(k, m.start(), m.end()) for k, p, ok in RULES for m in re.finditer(p, text or "") if ok(m[0])]


def spans(spark, texts):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, t string, found boolean")
    return {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find_pii(df).collect()}


def test_against_plain_search(spark):
    r = random.Random(4)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "22", "255", "256", "000", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "-", "+", "+1 (555) 123-4567", "(", ")", "é", "😀", "\n", "10.0.0.1", "%", "_"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(600)] + [None, "", "a" * 50000 + "@", "1" * 50000, "a@b" + ".c" * 20000, "1.2.3.4 " * 400]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] in pii.BASE] == base(t), repr(t)


def test_whole_table(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in queries.op8_weak_pii(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want = base(r.text)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert got[r.doc_id].n_card == sum(k == "card" for k, _, _ in want)


def test_what_is_added_on_the_given_tables(spark, sf):
    """No word of a licence is a name, no number that fails its checksum an account without words that say so, and no labeler is turned round."""
    d = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in pii.find_pii(d).collect():
        for kind, start, end in r.spans:
            value, around = texts[r.doc_id][start:end], texts[r.doc_id][max(0, start - pii.CONTEXT) : end + pii.CONTEXT].lower()
            assert kind in pii.BASE or kind != "person" or not set(value.split()) & set(pii.NO_NAMES), value
            assert kind != "account" or luhn(re.sub("[^0-9]", "", value)) or any(w in around for w in pii.FOR_WORDS["account"].split()), around
    weights = pii.fit(pii.candidates(d))
    assert all(weights[f"vote:{x}"] >= 0 and weights[f"vote:{x}"] + w >= -1e-9 for x in pii.LABELERS for k, w in weights.items() if k.startswith(f"{x}:")), weights


def test_directed():
    import numpy as np

    t = np.array([[0.2, 0.3, 0.5], [0.6, 0.3, 0.1]])  # turned round on both sides
    out = pii._directed(t, np.array([3.0, 1.0]))
    assert out[0].tolist() == out[1].tolist() and abs(out.sum(axis=1) - 1).max() < 1e-9
    good = np.array([[0.6, 0.3, 0.1], [0.2, 0.3, 0.5]])
    assert np.allclose(pii._directed(good, np.array([3.0, 1.0])), good)


def iban(rng, country="DE"):
    body = "".join(rng.choice("0123456789") for _ in range(18))
    n = int(body + "".join(str(int(c, 36)) for c in country) + "00")
    return f"{country}{98 - n % 97:02d}{body}"


def planted(seed, n):
    """(text, spans that are personal, looser candidates that are not), each with words and data about it as they come."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(3, 8)))
    name = lambda: f"{rng.choice(pii.GIVEN)} {rng.choice(pii.FAMILY)}"
    local = lambda: f"{rng.choice('23456789')}{digits(2)}-{rng.choice('23456789')}{digits(2)}-{digits(4)}"
    date = lambda: f"{rng.randint(1940, 2005)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}"
    good = {
        "phone_local": lambda: (rng.choice(["call", "phone", "mobile", ""]), local()),
        "national_id": lambda: (rng.choice(["ssn", "social security", ""]), f"{rng.randint(100, 650)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"),
        "iban": lambda: (rng.choice(["iban", "bank account", ""]), iban(rng)),
        "account": lambda: (rng.choice(["visa card", "credit card", "debit"]), f"4{digits(3)} {digits(4)} {digits(4)} {digits(3)}"),
        "person": lambda: (rng.choice(["patient", "contact", "dear", ""]), name()),
        "address": lambda: (rng.choice(["lives at", "resident of", "home"]), f"{rng.randint(1, 999)} {rng.choice(pii.STREET_NAMES)} {rng.choice(pii.STREETS)}"),
        "birth_date": lambda: (rng.choice(["born", "dob", "birthday"]), date()),
        "email_text": lambda: (rng.choice(["mail", "write", ""]), f"{word()} (at) {word()} (dot) com"),
    }
    odd = lambda: "".join(rng.choice("bcdfgh") for _ in range(5)).capitalize()
    bad = {
        "phone_local": lambda: (rng.choice(["order", "part", "sku"]), rng.choice([f"0{digits(2)}.1{digits(2)}-{digits(4)}", "{0}{0}{0}-{0}{0}{0}-{0}{0}{0}{0}".format(rng.choice("23456789"))])),
        "national_id": lambda: (rng.choice(["serial", "ticket", "order"]), f"000-{digits(2)}-{digits(4)}"),
        "iban": lambda: (rng.choice(["part", "serial", "batch"]), f"XX00{digits(18)}"),
        "account": lambda: (rng.choice(["serial", "isbn", "inventory"]), f"9{digits(14)}"),
        "person": lambda: (rng.choice(["museum", "university", "theatre", ""]), f"{odd()} {odd()}"),
        "address": lambda: (rng.choice(["version", "release", "build"]), f"{rng.randint(10000, 99999)} {odd()} Court"),
        "birth_date": lambda: (rng.choice(["updated", "published", "deadline"]), date()),
    }
    out = []
    for _ in range(n):
        text, own, others = word(), [], []
        close = rng.random() < 0.4
        if close:  # data come together
            text += f" {word()}@{word()}.com"
        for _ in range(rng.randint(1, 3)):
            real = rng.random() < (0.8 if close else 0.4)
            kind = rng.choice(sorted(good if real else bad))
            context, value = (good if real else bad)[kind]()
            behind = rng.random() < 0.3  # the word comes after
            text += " " + " ".join(word() for _ in range(8)) + ("" if behind else f" {context}") + " "
            (own if real else others).append((kind, len(text), len(text) + len(value)))
            text += value + (f" {context}" if behind else "")
        out.append((text + " " + " ".join(word() for _ in range(9)), own, others))
    return out


def test_planted_spans_are_told_apart(spark):
    """Precision and recall of the looser kinds on labelled plants that no labeler tells apart alone; every labeler counts."""
    rows = planted(5, 1500)
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(rows)], "doc_id long, text string")
    got = {(r.doc_id, *s) for r in pii.find_pii(df).collect() for s in r.spans if s[0] not in pii.BASE}
    want = {(i, *s) for i, (_, own, _) in enumerate(rows) for s in own}
    others = {(i, *s) for i, (_, _, o) in enumerate(rows) for s in o}
    hit = len(got & want)
    assert hit / len(want) > 0.9 and hit / len(got) > 0.9 and len(got & others) / len(others) < 0.1
    for kind in {s[1] for s in want}:
        own = {x for x in want if x[1] == kind}
        assert len(own & got) / len(own) > 0.7, kind
    weights = pii.fit(pii.candidates(df))
    assert all(weights[f"vote:{x}"] > 0.05 for x in pii.LABELERS), weights


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).count() == 0


def test_reliable_labelers_win():
    """Six labelers of known reliability: the estimate finds them, and follows the reliable ones."""
    rng = random.Random(1)
    right, counts = (0.95, 0.9, 0.85, 0.6, 0.75, 0.8), {}
    for _ in range(20_000):
        y = rng.random() < 0.3
        votes = tuple((1 if y == (rng.random() < r) else -1) if rng.random() < 0.8 else 0 for r in right)
        n = counts.setdefault(votes, [0, 0])
        n[y] += 1
    patterns = [("a", v, (0, 0), sum(n)) for v, n in sorted(counts.items())]
    post, told = pii.estimate(patterns)
    for t, r in zip(told, right, strict=True):
        assert abs(t[1][0] / (t[1][0] + t[-1][0]) - r) < 0.05
    wrong = sum(counts[p[1]][0] if q > 0.5 else counts[p[1]][1] for p, q in zip(patterns, post, strict=True))
    assert wrong < 20_000 * 0.06
    w = pii.classifier(patterns, post)
    assert w["vote:form"] > w["vote:after"] > 0


def test_iban_and_dates(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(iban(rng), True) for _ in range(20)] + [("GB82 WEST 1234 5698 7654 32", True), ("GB83 WEST 1234 5698 7654 32", False), ("DE00", False)]
    df = spark.createDataFrame(rows, "v string, want boolean")
    assert all(r.got == r.want for r in df.select("want", pii._iban(F.col("v")).alias("got")).collect())
