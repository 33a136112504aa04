import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = [
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "a b c d e " * 4),
    (6, "x\n \nx\ny\n\nx # * $ % & | < >"),
    (6, "x\n \nx\ny\n\nx # * $ % & | < >"),
    (None, "ten words are in here, and so it is long enough now"),
    (8, "é́   　x 𝒳𝒳 ÀÉ" * 3),
    (9, "long " + "w" * 300_000),
]


def measured(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_measurements_against_brute_force(spark):
    got = quality.ledger(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((i, *measured(t)) for i, t in ROWS), key=key)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab#\n \t\x0b é", max_size=60), min_size=1, max_size=20))
def test_random_texts(spark, texts):
    got = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: measured(t) for i, t in enumerate(texts)}


def test_ablation_counts_what_each_rule_alone_rejects(spark):
    rows = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,), (32,)], "failed long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_docs) for r in quality.ablation(rows, "v2").collect()}
    assert got["too_few_words"] == (2, 1, 6) and got["repeated_words"] == (3, 2, 6) and got["shouting"] == (1, 1, 6) and got["symbols"] == (0, 0, 6)
    assert quality.apply_policy(rows, "base").filter("kept").count() == 2  # bits of other rules do not count
    assert {r.n_docs for r in quality.ablation(rows.limit(0), "v1").collect()} == {0}


def test_filter_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("n_words", F.lit("own")).withColumn("failed", F.lit(7)).withColumn("w_", F.lit(1))
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, None} and kept.first().n_words == "own"


def test_no_python_on_the_main_path(spark, sf):
    plan = queries.op2_quality_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
