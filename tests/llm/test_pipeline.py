import duckdb
import pyarrow.parquet as pq
import pytest
from tests.llm.test_mixing import brute as targets
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_packing import check as packed
from tests.llm.test_secret_scan import base
from tidewire.llm import packing, queries

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    columns = docs.columns

    con = duckdb.connect()
    con.register("documents", pq.read_table(f"{sf}/documents.parquet"))
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({queries.oracle_sql()['op2_quality_ledger']}) WHERE kept").fetchall()}
    kept = stages["quality"](spark, docs, sf)
    assert kept.columns == columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == want and len(rows) == len(want)

    kept = spark.createDataFrame(rows, docs.schema)
    least = {c for _, c, _ in classes([(r.doc_id, r.text) for r in rows])}
    single = stages["near_duplicates"](spark, kept, sf)
    assert single.columns == columns
    left = single.collect()
    assert sorted(r.doc_id for r in left) == sorted(least)
    assert {r for r in left} <= {r for r in rows}

    clean = stages["secrets"](spark, spark.createDataFrame(left, docs.schema), sf).collect()
    assert len(clean) == len(left) and not any(base(r.text) for r in clean)
    before = {r.doc_id: r for r in left}
    assert all(r.text == before[r.doc_id].text for r in clean if "[SECRET]" not in r.text)

    mixed = stages["mix"](spark, spark.createDataFrame(clean, docs.schema), sf)
    assert mixed.columns == columns
    many = mixed.collect()
    size, taken = {}, {}
    for rs, out in ((clean, size), (many, taken)):
        for r in rs:
            out[r.source] = out.get(r.source, 0) + len(r.text.split())
    most = {s: max(len(r.text.split()) for r in clean if r.source == s) for s in size}
    assert all(t - most[s] - 1e-6 <= taken.get(s, 0) <= t + 1e-6 for s, t in targets(size).items())

    unique = {r.doc_id: r for r in many}.values()
    out = stages["packing"](spark, spark.createDataFrame(list(unique), docs.schema), sf)
    padding, total = packed(out.collect(), {r.doc_id: r.text for r in unique})
    assert padding < 0.05 * total and packing.CAPACITY == 1024


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, size long"
    text = " ".join(f"w{i}" for i in range(40))
    odd = [(None, text, None, None, None, "k", "r", 1), (1, None, "en", "a", 0, None, None, None), (2, "", "en", "a", 0, "k", "r", 2), (3, text, "en", "a", 1, "k", "r", 3), (3, text, "en", "a", 1, "k", "r", 3)]
    docs = spark.createDataFrame(odd, schema)
    for rows in (docs, docs.limit(0)):
        for _, stage in pipeline.STAGES[:-1]:
            rows = stage(spark, rows, sf)
            assert rows.columns == docs.columns
            rows = spark.createDataFrame(rows.collect(), schema)
        assert (pipeline.STAGES[-1][1](spark, rows, sf).count() > 0) == (rows.count() > 0)


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0
