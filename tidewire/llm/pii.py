"""Personal data by weak supervision, in DataFrame functions alone.

Regexes propose spans, wide on purpose; labelers vote on each one: +1 for, -1 against, 0 for no opinion.
``form`` checks what a number must obey (checksums, ranges), where there is such a thing; ``gazetteer``
looks parts up in tables of names, streets, cities, calling codes, issuers and mail endings; ``before``
and ``after`` read the words on either side; ``look`` knows fillers and samples by their characters;
``company`` tells whether other personal data stand close by. No vote is taken as the truth.

Candidates of the whole corpus are counted by kind, votes and features (classes of length and of the
share of digits), of which there are a bounded number whatever the corpus. Expectation-maximisation over
these counts estimates the labelers' reliabilities and a posterior for each pattern. The posteriors train
the span classifier, a logistic regression over votes, features and kind; it decides on the spans of the
looser kinds. Spans of the base kinds are decided by their checks, as the contract has it; they take part
in the estimate as any other candidates do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Code points read on either side of a span, and within which other data are company.
CONTEXT, COMPANY = 40, 80
EM_ROUNDS, FIT_ROUNDS, RIDGE, LEAN = 40, 25, 0.5, 0.5
LABELERS = ("form", "gazetteer", "before", "after", "look", "company")
FEATURES = ("size", "digits")
#: Labelers whose votes for a looser span have to outnumber those against: company and looks alone carry none.
VOUCHING = ("form", "gazetteer", "before", "after")

#: The gazetteers.
ENDINGS = "com org net edu gov io de fr es uk eu info biz us ca it nl ch at be se no dk pl pt ie jp cn in br ru au nz mx".split()
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|62)"
CALLING_CODES = r"^(1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-8]|2[2-9][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|8[05789][0-9]|9[679][0-9])"
GIVEN = """Aaron Adam Alan Alice Amanda Amy Ana Andrea Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Brian Carla Carlos Carmen Carol Charles Chloe Chris Claire Clara Daniel David Deborah
Diana Donald Edward Elena Elizabeth Emily Emma Eric Eva Frank George Grace Greta Hannah Hans Helen Henry Ines Jack Jacob James Jane Jean Jennifer Jessica John Jonas Jorge Jose Joseph Juan Julia Karen Karl
Katherine Kevin Klaus Laura Lena Linda Lisa Louis Lucia Luis Manuel Margaret Maria Marie Mark Martin Mary Matthew Michael Miguel Monika Nancy Nicole Olivia Oscar Otto Pablo Patricia Paul Peter Petra Philip
Pierre Rachel Richard Robert Rosa Ruth Samuel Sandra Sara Sarah Sofia Sophie Stefan Stephen Susan Thomas Ursula Victor Walter William""".split()
FAMILY = """Adams Allen Anderson Bailey Baker Bauer Becker Bell Bennett Bernard Brooks Brown Campbell Carter Clark Collins Cook Cooper Cox Davis Diaz Dubois Durand Edwards Evans Fernandez Fischer Fisher Flores
Foster Garcia Gomez Gonzalez Gray Green Hall Harris Hernandez Hill Hoffmann Howard Hughes Jackson Jenkins Johnson Jones Kelly King Klein Koch Lambert Lee Lefebvre Leroy Lewis Long Lopez Martin Martinez Meyer
Miller Mitchell Moore Moreau Moreno Morgan Morris Muller Murphy Myers Navarro Nelson Parker Perez Peterson Phillips Powell Price Ramirez Reed Reyes Richter Rivera Roberts Robinson Rodriguez Rogers Ross Roux
Ruiz Sanchez Sanders Schmidt Schneider Scott Simon Smith Stewart Sullivan Taylor Thomas Thompson Torres Turner Walker Wagner Ward Watson Weber White Williams Wilson Wolf Wood Wright Young""".split()
CITIES = """Amsterdam Athens Atlanta Austin Barcelona Berlin Bordeaux Boston Brussels Chicago Cologne Copenhagen Dallas Denver Detroit Dresden Dublin Edinburgh Frankfurt Geneva Glasgow Hamburg Houston Leeds Leipzig
Lille Lisbon London Lyon Madrid Manchester Marseille Miami Milan Munich Nantes Nice Oslo Oxford Paris Philadelphia Phoenix Porto Portland Prague Rome Seattle Seville Springfield Stockholm Strasbourg Stuttgart
Toulouse Valencia Vienna Warsaw Zurich""".split()
STREETS = "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Terrace".split()
STREET_NAMES = "Main Oak Maple Cedar Pine Elm High Church Park Mill Station Bridge King Queen Victoria Washington Lincoln Franklin Jefferson Hill Lake River Spring Garden School North South East West Market Chestnut Walnut".split()
#: Words beside such data, by kind, and beside other numbers and names.
FOR_WORDS = {
    "email": "email mail e-mail contact write reach address", "email_text": "email mail e-mail contact write reach", "ip": "ip host address login client from", "card": "card visa mastercard amex credit debit pay expires cvv",
    "phone": "phone tel telephone call fax mobile cell contact reach", "phone_local": "phone tel telephone call fax mobile cell contact reach", "national_id": "ssn social security tax insurance id",
    "iban": "iban account bank transfer bic", "account": "card visa mastercard amex credit debit account bank pay expires cvv", "person": "mr mrs ms dr prof name dear contact patient author sincerely regards met born resident employee lives",
    "address": "address lives live resident home at deliver mail", "birth_date": "born birth birthday dob age",
}
AGAINST_WORDS = "license licence licensed version isbn order invoice page figure build release sku doi ticket serial part model batch inventory published updated deadline museum university theatre festival company corporation inc ltd example sample placeholder".split()
#: Words that begin with a capital beside another one and are no part of a name.
NO_NAMES = """Academy Act Agreement Apache Association April August Avenue Bank Board Bureau Center Centre Chapter City Clause College Commission Committee Commons Company Conference Corporation Council County
Court Creative December Department East European Federal February Figure Foundation Free Friday Fund General Government Group High Hospital House Institute International January July June Lake Law Library
License Licence Limited March Market Ministry Monday Museum National Network New North November October Office Open Park Policy Press Project Public Republic River Road Royal Saturday School Section
Security September Service Services Social Society Software Source South Standard State States Station Street Sunday System Systems Table Terms Theatre Thursday Trade Treaty Tuesday Union United
University Version Wednesday West World""".split()


@dataclass(frozen=True)
class Kind:
    """``maybe`` is a cheap test that a text has to pass; ``ok`` decides on a base kind and is the form labeler, which has no opinion where a kind has none."""

    name: str
    pattern: str
    maybe: Callable[[Column], Column]
    ok: Callable[[Column], Column] | None
    base: bool = True


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column, least: int = 16) -> Column:
    """So many to 19 digits whose Luhn sum ends in 0."""
    d = F.translate(v, " -", "")
    each = F.transform(F.split(F.reverse(d), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.length(d).between(least, 19) & (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0)


def _iban(v: Column) -> Column:
    """The check digits hold: the number with its first four characters last, letters as 10 to 35, is 1 modulo 97."""
    x = F.translate(v, " ", "")
    chars = F.split(F.concat(F.substring(x, 5, 64), F.substring(x, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(c.cast("int"))
    rest = F.aggregate(F.transform(F.filter(chars, lambda c: c != ""), value), F.lit(0), lambda a, n: (a * F.when(n > 9, 100).otherwise(10) + n) % 97)
    return F.length(x).between(15, 34) & (rest == 1)


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: In the order of listing. The contract's patterns, with starts and possessive loops that let no run be read twice:
#: a match that starts inside a run could start earlier in it, unless the last match ended there.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), None),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda v: v.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _luhn),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), lambda v: F.length(_digits(v)).between(8, 15)),
    Kind("email_text", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]) ?[A-Za-z]{2,24}", lambda t: t.contains("(dot)") | t.contains("[dot]"), None, False),
    Kind("phone_local", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])", lambda t: t.rlike("[0-9]{3}[.-][0-9]{4}"), lambda v: _digits(v).rlike("^[2-9][0-9]{2}[2-9]"), False),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda v: ~v.rlike("^(?:000|666|9)|-00-|0000$"), False),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), lambda v: _iban(v), False),
    Kind("account", r"(?<![A-Za-z0-9.-])[0-9]{4}(?:[\x20-]?[0-9]){9,15}(?![A-Za-z0-9-])", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: _luhn(v, 13), False),
    Kind("person", r"(?<![\p{L}\p{N}.'-])[A-Z][a-z]{1,20} (?:[A-Z]\. )?[A-Z][a-z]{1,20}(?![\p{L}\p{N}'-])", lambda t: t.rlike(r"[A-Z][a-z]{1,20} (?:[A-Z]\. )?[A-Z][a-z]"), None, False),
    Kind("address", rf"(?<![0-9A-Za-z.,-])[0-9]{{1,5}} (?:[A-Z][a-z]{{1,20}} ){{1,2}}(?:{'|'.join(STREETS)})(?![A-Za-z])", lambda t: t.rlike(r"[0-9] [A-Z][a-z]"), None, False),
    Kind("birth_date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9/-])", lambda t: t.rlike(r"[0-9][/-][0-9]{1,2}[/-][0-9]"), lambda v: F.try_to_timestamp(F.when(v.contains("-"), v), F.lit("yyyy-MM-dd")).isNotNull() | v.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])/(?:0?[1-9]|[12][0-9]|3[01])/(?:19|20)"), False),
)
BASE = tuple(k.name for k in KINDS if k.base)
_FOUND = "array<struct<start:int,end:int,value:string>>"


def _matches(t: Column, pattern: str) -> Column:
    """All matches, leftmost first and not overlapping, with their places in code points: those of the pieces between them, summed up."""
    values, pieces = F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.split(t, pattern, -1)
    pairs = F.zip_with(values, F.slice(pieces, F.lit(1), F.size(values)), lambda v, p: F.struct(v.alias("v"), F.length(p).alias("p")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + F.length(x["v"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["v"].alias("value"))).cast(_FOUND).alias("out"))

    return F.aggregate(pairs, none, add, lambda acc: acc["out"])


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0)


def _case(kind: Column, values: dict[str, Column], other: Column) -> Column:
    out = None
    for k, v in values.items():
        out = (F if out is None else out).when(kind == k, v)
    return out.otherwise(other)


def _has(text: Column, names: list[str]) -> Column:
    """Whether one of the words is in a text in lower case."""
    return text.rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(names) + r")(?![\p{L}\p{N}])")


def _gazetteer(kind: Column, v: Column, after: Column) -> Column:
    mail = _vote(F.lower(F.regexp_extract(v, r"([A-Za-z]+)$", 1)).isin(ENDINGS))
    issuer = _vote(_digits(v).rlike(ISSUERS), F.lit(True))
    given, family = F.substring_index(v, " ", 1).isin(GIVEN), F.substring_index(v, " ", -1).isin(FAMILY)
    street = F.regexp_extract(v, r"^[0-9]+ ([A-Z][a-z]+)", 1).isin(STREET_NAMES)
    city = after.rlike("(?:" + "|".join(CITIES) + ")")
    return _case(kind, {
        "email": mail, "email_text": mail, "ip": _vote(F.lit(False), v.rlike(r"^(?:10|127|192\.168|169\.254)\.|^0")), "card": issuer, "account": issuer, "phone": _vote(_digits(v).rlike(CALLING_CODES), F.lit(True)),
        "person": _vote(given | family, F.lit(True)), "address": _vote(street | city, ~city & (F.length(F.regexp_extract(v, "^[0-9]+", 0)) > 4)),
    }, F.lit(0))


def _look(kind: Column, v: Column) -> Column:
    """Against fillers (one digit over and over, digits in order, one word twice, all zeros) and names of things, for groups of digits as people write them."""
    d = _digits(v)
    thing = (kind == "person") & (F.substring_index(v, " ", 1).isin(NO_NAMES) | F.substring_index(v, " ", -1).isin(NO_NAMES))
    filler = d.rlike(r"^(\d)\1{6,}$") | d.rlike("^(?:0123456|1234567|9876543)") | v.rlike(r"^([A-Za-z]+) \1$") | v.rlike(r"(?i)\b(?:foo|bar|test|example|user|name)\b")
    return F.when(filler | thing, -1).when(kind.isin("card", "account", "iban", "phone", "phone_local") & v.rlike(r"[0-9)][ -][0-9]"), 1).otherwise(0)


def _labels(t: Column, taken: Column, c: Column) -> dict[str, Column]:
    """Each labeler's vote on a candidate (kind, start, end, value, form) of text t, whose base spans that pass are ``taken``."""
    kind, v = c["kind"], c["value"]
    before = F.substring(t, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
    after = F.substring(t, c["end"] + 1, F.lit(CONTEXT))

    def words(side: Column) -> Column:
        low = F.lower(side)
        return _vote(_case(kind, {k: _has(low, w.split()) for k, w in FOR_WORDS.items()}, F.lit(False)), _has(low, AGAINST_WORDS))

    near = F.exists(taken, lambda b: (b["start"] != c["start"]) & (b["start"] < c["end"] + COMPANY) & (b["end"] > c["start"] - COMPANY))
    return {"form": c["form"], "gazetteer": _gazetteer(kind, v, after), "before": words(before), "after": words(after), "look": _look(kind, v), "company": _vote(near)}


def _features(c: Column) -> dict[str, Column]:
    """Classes of a span's length and of its share of digits."""
    v = c["value"]
    share = F.length(_digits(v)) / F.greatest(F.length(v), F.lit(1))
    return {"size": F.when(F.length(v) <= 11, 0).when(F.length(v) <= 15, 1).when(F.length(v) <= 19, 2).otherwise(3), "digits": F.when(share == 0, 0).when(share < 0.7, 1).otherwise(2)}


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id and ``found``, its candidates with kind, start, end, base, ok, one vote a labeler, and features."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("digit", F.col("t").rlike("[0-9]"))
    plain = ("email", "email_text", "person")  # need no digit
    t, none = F.col("t"), F.array().cast(_FOUND)
    for k in KINDS:
        gate = k.maybe(t) if k.name in plain else F.col("digit") & k.maybe(t)
        d = d.withColumn(k.name, F.when(gate, _matches(t, k.pattern)).otherwise(none))
    d = d.select("doc_id", "t", F.concat(*map(_tagged, KINDS)).alias("all"))
    d = d.withColumn("taken", F.filter("all", lambda c: c["base"] & c["ok"]))
    # a looser kind has no say where a base span lies
    free = lambda c: c["base"] | ~F.exists("taken", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    d = d.select("doc_id", "t", "taken", F.filter("all", free).alias("kept"))

    def told(c: Column) -> Column:
        votes = _labels(F.col("t"), F.col("taken"), c) | _features(c)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), c["ok"].alias("ok"), *(v.cast("int").alias(n) for n, v in votes.items()))

    return d.select("doc_id", F.transform("kept", told).alias("found"))


def _tagged(k: Kind) -> Column:
    def tag(x: Column) -> Column:
        ok = F.coalesce(k.ok(x["value"]), F.lit(False)) if k.ok else F.lit(True)
        form = F.when(ok, 1).otherwise(-1) if k.ok else F.lit(0)
        return F.struct(F.lit(k.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), F.lit(k.base).alias("base"), ok.alias("ok"), form.alias("form"))

    return F.transform(F.col(k.name), tag)


#: A pattern: kind, one vote a labeler, features, and how many candidates have them.
Pattern = tuple[str, tuple[int, ...], tuple[int, ...], int]


def _directed(table: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Probabilities (not personal, personal; ..; votes -1, 0, 1) in which a vote for is no rarer on personal data than on others, and a vote against no more frequent.

    Where the counts say otherwise both sides take their mean, weighed by ``mass``; votes of 0 take what is left.
    """
    out = table.copy()
    share = mass[1] / np.maximum(mass[0] + mass[1], 1e-9)
    for vote, sign in ((2, 1), (0, -1)):
        turned = sign * (out[1, ..., vote] - out[0, ..., vote]) < 0
        mean = (1 - share) * out[0, ..., vote] + share * out[1, ..., vote]
        for side in (0, 1):
            out[side, ..., vote] = np.where(turned, mean, out[side, ..., vote])
    out[..., 1] = np.maximum(1 - out[..., 0] - out[..., 2], 1e-9)
    return out


def estimate(patterns: list[Pattern]) -> tuple[list[float], list[dict]]:
    """Posteriors that candidates of each pattern are personal data, and each labeler's reliability: how its votes fall on such data and on others.

    Expectation-maximisation with one prior a kind, from a start at the mean of the votes cast; where none is, from a low one. A labeler has
    a table over all kinds, smoothed by one candidate a cell, and one a kind that is mixed with it (``LEAN``): what vouches for one kind
    says less of another. Labelers are held to their direction (``_directed``), so that none can be turned round where votes are few.
    """
    kinds = {k: i for i, k in enumerate(sorted({p[0] for p in patterns}))}
    kind = np.array([kinds[p[0]] for p in patterns], dtype=int)
    votes = np.array([p[1] for p in patterns], dtype=int).reshape(len(patterns), len(LABELERS))
    n = np.array([p[3] for p in patterns], dtype=float)
    cast = (votes != 0).sum(axis=1)
    post = np.where(cast > 0, 0.5 + 0.4 * votes.sum(axis=1) / np.maximum(cast, 1), 0.2)
    tables = np.zeros((len(LABELERS), 2, 3))
    for _ in range(EM_ROUNDS):
        weights = np.stack([n * (1 - post), n * post])
        prior = np.stack([1 + np.bincount(kind, w, minlength=len(kinds)) for w in weights])
        odds = np.log(prior[1, kind] / prior[0, kind])
        for i in range(len(LABELERS)):
            cells = np.stack([np.bincount(kind * 3 + votes[:, i] + 1, w, minlength=3 * len(kinds)).reshape(-1, 3) for w in weights])
            mass = cells.sum(axis=2)
            tables[i] = _directed((1 + cells.sum(axis=1)) / (3 + mass.sum(axis=1))[:, None], mass.sum(axis=1))
            own = _directed((1 - LEAN) * cells / np.maximum(mass[:, :, None], 1e-9) + LEAN * tables[i][:, None, :], mass)
            odds = odds + np.log(own[1, kind, votes[:, i] + 1] / own[0, kind, votes[:, i] + 1])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    told = [{v: (float(t[1, v + 1]), float(t[0, v + 1])) for v in (-1, 0, 1)} for t in tables]
    return post.tolist(), told


def classifier(patterns: list[Pattern], post: list[float]) -> dict[str, float]:
    """Weights of the span classifier by name: ``vote:<labeler>`` and what ``<labeler>:<kind>`` adds, ``<feature>:<class>``, ``kind:<kind>`` and ``bias``.

    A logistic regression fitted to the posteriors by Newton's method, with a ridge. A labeler's weight, and what it comes to on each kind, is held at 0 or above.
    """
    names = [*(f"vote:{x}" for x in LABELERS), *sorted({f"{f}:{c}" for p in patterns for f, c in zip(FEATURES, p[2], strict=True)}), *(f"{x}:{k}" for k in sorted({p[0] for p in patterns}) for x in ("kind", *LABELERS)), "bias"]
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(patterns), len(names)))
    for row, (kind, votes, features, _) in zip(x, patterns, strict=True):
        row[: len(LABELERS)] = votes
        row[[at[f"{x}:{kind}"] for x in LABELERS]] = votes
        row[[at[f"kind:{kind}"], at["bias"], *(at[f"{f}:{c}"] for f, c in zip(FEATURES, features, strict=True))]] = 1
    n, y = np.array([p[3] for p in patterns], dtype=float), np.array(post)
    n = n / max(n.sum(), 1) * 1000  # so that the ridge weighs alike at every size
    w = np.zeros(len(names))
    for _ in range(FIT_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + RIDGE * w
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(names))
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 4 / max(float(np.abs(step).max()), 1e-12))
        for i, labeler in enumerate(LABELERS):
            w[i] = max(w[i], 0.0)
            own = [j for name, j in at.items() if name.startswith(f"{labeler}:")]
            w[own] = np.maximum(w[own], -w[i])
    return dict(zip(names, w.tolist(), strict=True))


def fit(told: DataFrame) -> dict[str, float]:
    """The span classifier of the candidates in ``told``; what reaches the driver is a row a pattern, of a bounded number of patterns."""
    each = told.select(F.explode("found").alias("c")).select("c.*")
    counted = each.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((r.kind, tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r.n) for r in counted)
    return classifier(patterns, estimate(patterns)[0])


def find_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id and ``spans`` (kind, start, end), by kind as listed, then start.

    Base spans are those that pass their checks; the looser kinds are added where the classifier
    says so and more labelers of ``VOUCHING`` vote for them than against, the longest of those that overlap. A null text has none; nulls, repeated and very long texts need nothing special.
    """
    told = materialize(candidates(docs, key, text), "pii")
    weights = fit(told)

    def good(c: Column) -> Column:
        odds = F.lit(weights["bias"])
        for name in LABELERS:
            odds = odds + c[name] * _case(c["kind"], {k.name: F.lit(weights[f"vote:{name}"] + weights.get(f"{name}:{k.name}", 0.0)) for k in KINDS}, F.lit(0.0))
        for name in (*FEATURES, "kind"):
            known = {k.split(":")[1]: w for k, w in weights.items() if k.startswith(f"{name}:")}
            odds = odds + (_case(c[name].cast("string"), {k: F.lit(w) for k, w in known.items()}, F.lit(0.0)) if known else F.lit(0.0))
        vouched = sum((c[x] for x in VOUCHING), F.lit(0)) > 0
        return F.when(c["base"], c["ok"]).otherwise(vouched & (odds > 0))

    told = told.select("doc_id", F.filter("found", good).alias("spans"))
    size = lambda c: c["end"] - c["start"]
    inside = lambda c: F.exists("spans", lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (size(o) > size(c)))
    return told.select("doc_id", F.transform(F.filter("spans", lambda c: c["base"] | ~inside(c)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].cast("long").alias("start"), c["end"].cast("long").alias("end"))).alias("spans"))
