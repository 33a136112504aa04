"""Every operator over empty tables, nulls in any column, repeated rows, and extra columns whose names clash with its own."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import ann, chat, langid, mixing, ngram_join, packing, pii, ppm, quality, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LONG = "some words of a text that goes on " * 20_000
ROWS = [(1, "the quick brown fox jumps over it", "en", "a", 30), (1, "the quick brown fox jumps over it", "en", "a", 30), (None, "the quick brown fox jumps over it", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0), (4, " \n\t ", "fr", None, 4), (5, LONG, "fr", "b", len(LONG)), (6, "123 +++ 456", "en", "a", 11)]

OPERATORS = {
    "packing": lambda d: packing.pack(d, BPE),
    "quality": quality.ledger,
    "ngram_join": ngram_join.join,
    "langid": langid.predict,
    "mixing": mixing.mix,
    "pii": pii.find_pii,
    "secret_scan": secret_scan.find_secrets,
    "ppm": ppm.score,
}
#: Names that the operators use inside.
CLASHES = "key row block number word h h2 size s b spans found kind t copies class_id n_links keep ids start length failed n_words w_ g_ told held_out score".split()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("name", OPERATORS)
def test_documents(spark, docs, name):
    run = OPERATORS[name]
    assert run(docs.limit(0)).collect() == []
    got = run(docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))).collect()
    ids = sorted((r.doc_id for r in got), key=str)
    if name == "packing":
        assert set(ids) == {r[0] for r in ROWS}
    else:
        assert ids == sorted((r[0] for r in ROWS), key=str)
    nulls = docs.select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    assert len(run(nulls).collect()) == len(ROWS)


def test_columns_of_pipeline_stages(spark, docs):
    more = docs.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for table in (more, more.limit(0), more.select(*(F.lit(None).cast(t).alias(c) for c, t in more.dtypes))):
            out = stage(spark, table, "")
            assert out.dtypes == more.dtypes, name
            assert all(r.key == "own key" for r in out.collect()) or table is not more


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    run = lambda rows: chat.digest(chat.format_turns(spark.createDataFrame(rows, schema))).collect()
    assert run([]) == []
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in run([(None, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, None, "assistant", "[/INST]\\</s>")])}
    assert got == {None: (1, 0), 1: (3, 12)}


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    run = lambda rows: ann.neighbours(spark.createDataFrame(rows, schema).withColumn("v", F.lit("own")), 100, 10).collect()
    assert run([]) == []
    bad = [(100, None, 1), (200, [], 1), (300, [0.0, 0.0], 1), (400, [float("nan"), 1.0], 1), (500, [None, 1.0], 1), (None, [1.0, 1.0], 1)]
    assert run(bad) == []
    got = run([*bad, (0, [1.0, 0.0], None), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 1.0], 1), (4, [1.0], 1)])
    assert sorted((r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, round(2**0.5, 6))]
