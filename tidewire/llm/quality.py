"""Quality rules: a ledger of rule failures as bits, with policies and ablations on top.

Every rule is evaluated once a document. The ledger keeps the measurements and one
bigint whose bit i says that rule i failed. A policy is a versioned set of rules, hence a
mask; applying one, or asking what each rule costs, needs the ledger alone and no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, words

WINDOW = 5
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """``fails`` takes a function from measurement name to column."""

    name: str
    fails: callable


#: The bit of a rule is its place here; append only, so that old ledgers stay readable.
RULES = (
    Rule("too_few_words", lambda m: m("n_words") < 10),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 10 * m("n_symbols") > m("n_words")),
    Rule("duplicate_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 15 * m("n_words"))),
    Rule("shouting", lambda m: 2 * m("n_upper") > m("word_chars")),
)
BITS = {rule.name: 1 << i for i, rule in enumerate(RULES)}
#: Versions are never edited, only added.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "word_length"),
    "v2": tuple(BITS),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once; a lambda would compute it again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeats(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more: windows sorted by hash, then the union of the flagged ones."""

    def same(s: Column, k: Column, g: Column) -> Column:
        return F.coalesce(F.get(s, k)["g"] == g, F.lit(False))

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    starts = _let(ordered, lambda s: F.transform(F.filter(s, lambda x, k: same(s, k - 1, x["g"]) | same(s, k + 1, x["g"])), lambda x: x["i"]))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("covered"))
    return F.aggregate(
        F.sort_array(starts), none, lambda acc, i: F.struct(i.alias("last"), (acc["covered"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("covered"))
    )["covered"]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measurements; a null text counts as an empty one, any other column stays as it is.

    Windows are compared by a 64-bit hash of their five words.
    """
    t, w, g, lines = fresh(df, "t_", "w_", "g_", "lines_")
    body = F.coalesce(F.col(text), F.lit(""))
    step = df.withColumn(t, body).withColumn(w, words(F.col(t)))
    step = step.withColumn(
        g,
        F.when(
            F.size(w) > WINDOW,
            F.zip_with(
                F.slice(F.col(w), F.lit(1), F.size(w) - WINDOW + 1),
                F.sequence(F.lit(2), F.size(w) - WINDOW + 2),
                lambda first, i: F.xxhash64(first, *(F.get(F.col(w), i + k) for k in range(-1, WINDOW - 2))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    ).withColumn(lines, F.filter(F.split(F.col(t), "\n"), lambda x: F.translate(x, _BLANKS, "") != ""))
    solid = F.translate(F.col(t), _BLANKS, "")
    values = {
        "n_words": F.size(w),
        "word_chars": F.length(solid),
        "n_symbols": F.length(F.col(t)) - F.length(F.translate(F.col(t), SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(F.col(lines))),
        "n_repeat_words": F.when(F.size(F.array_distinct(F.col(g))) == F.size(g), 0).otherwise(_repeats(F.col(g))),
        "n_upper": F.length(F.regexp_replace(solid, r"[^\p{Lu}]+", "")),
    }
    return step.select(*df.columns, *(v.cast("long").alias(k) for k, v in values.items()))


def failures(m=F.col) -> Column:
    """The bits of all failed rules."""
    out = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        out = out.bitwiseOR(F.when(rule.fails(m), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row a document: key, measurements, ``failed`` bits. Nulls, repeated and empty rows each keep theirs."""
    return measure(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", *MEASURES, failures().alias("failed"))


def verdict(failed: Column, policy: str) -> Column:
    return failed.bitwiseAND(F.lit(mask(policy)).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """The rows of a ledger with ``kept`` under the policy."""
    return rows.withColumn("kept", verdict(F.col(failed), policy))


def ablation(rows: DataFrame, policy: str, failed: str = "failed") -> DataFrame:
    """One row a rule of the policy: documents that fail it, and those which it alone rejects.

    One aggregation over bits; its state does not grow with the ledger.
    """
    bits = F.col(failed).bitwiseAND(F.lit(mask(policy)).cast("long"))
    sums = [F.sum(F.when(bits.bitwiseAND(F.lit(BITS[n]).cast("long")) != 0, 1).otherwise(0)).alias(f"f{i}") for i, n in enumerate(POLICIES[policy])]
    sums += [F.sum(F.when(bits == BITS[n], 1).otherwise(0)).alias(f"o{i}") for i, n in enumerate(POLICIES[policy])]
    one = rows.agg(F.count(F.lit(1)).alias("n"), *sums)
    return one.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("long").alias("n_failed"), F.coalesce(F.col(f"o{i}"), F.lit(0)).cast("long").alias("n_only"), F.col("n").cast("long").alias("n_docs"))
                    for i, n in enumerate(POLICIES[policy])
                )
            )
        )
    )


def filter_documents(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns only. A null text has no words, so it fails as an empty one does; repeated rows are judged alike.

    The row number keeps the filter above the measurements: pushed below them, it would be
    rewritten in terms of the text, with every measurement spelled out each time it is named.
    """
    inside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("text", F.col("row.text"))
    told = measure(inside).select("row", failures().alias("failed"), F.monotonically_increasing_id().alias("number"))
    return told.filter(verdict(F.col("failed"), policy) & (F.col("number") >= 0)).select("row.*")
