"""The queries of the training-data operators, with production parameters, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, clustering, langid, licenses, mixing, ngram_join, packing, pii, ppm, quality, repair, secret_scan


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), _tokenizer())


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.apply_policy(quality.ledger(_read(spark, sf_dir, "documents")), "v2")
    base = F.col("failed").bitwiseAND(F.lit(quality.mask("base")).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, and rejects alone, out of the ledger's bits."""
    return quality.ablation(quality.ledger(_read(spark, sf_dir, "documents")), "v2")


def op3_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(_read(spark, sf_dir, "embeddings"), 100, 10)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_read(spark, sf_dir, "documents")).drop("copies")


def op5_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(_read(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.format_turns(turns.unionByName(more)))


def op8_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(_read(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    base = secret_scan.listed(F.filter("spans", lambda s: s["kind"].isin(*pii.BASE)))
    return d.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op9_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = secret_scan.find_secrets(_read(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in secret_scan.BASE]
    base = secret_scan.listed(F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE)))
    return d.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


def op10_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_read(spark, sf_dir, "documents"), order=ppm.ORDER)


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.find_licenses(_read(spark, sf_dir, "documents")))


def op12_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered, centroids = clustering.cluster(clustering.vectors(_read(spark, sf_dir, "embeddings")), k=16, rounds=3, seed=1)
    return clustering.described(clustered, centroids).drop("scans")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations")
    return repair.repair(repair.damage(turns), turns.select("conv_id"))


def queries() -> dict:
    ops = (
        op1_harmonic_packing, op2_quality_ledger, op3_graph_neighbours, op4_ngram_join, op5_byte_gru_language, op6_source_mix, op7_chat_round_trip,
        op8_weak_pii, op9_secret_index, op10_ppm_score, op11_license_rules, op12_hamerly_clusters, op13_conversation_repair, quality_ablation,
    )
    return {f.__name__: f for f in ops}


_OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS l
  FROM documents
), g AS (
  SELECT rid, i, list_slice(w, i, i + 4) AS gram FROM d, unnest(range(1, greatest(len(w) - 3, 1))) AS u(i)
), twice AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) >= 2
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS v(k) GROUP BY rid
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(array_to_string(w, ''), '\P{Lu}', '', 'g'))::BIGINT AS n_upper
  FROM d LEFT JOIN r USING (rid)
), f AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""


_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS gram
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9
), reach(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a
)
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.a = d.doc_id)::BIGINT AS n_links
FROM d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""


_OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(30)) || chr(31) || coalesce(source, chr(30)) || chr(31) || coalesce(text, chr(30))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::DOUBLE AS weight FROM d GROUP BY source
), fill AS ( -- each round fills every source that its share overflows
  SELECT 0 AS k, source, weight, 3.0 * source_size AS cap, false AS is_full, (SELECT sum(source_size) FROM s)::DOUBLE AS total FROM s
  UNION ALL
  SELECT k + 1, source, weight, cap, is_full OR cap <= weight * level, total FROM (
    SELECT *, (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE NOT is_full) OVER (), 0) AS level FROM fill
  ) WHERE k < (SELECT count(*) FROM s)
), last AS (
  SELECT *, (total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0)) / nullif(sum(weight) FILTER (WHERE NOT is_full) OVER (), 0) AS level
  FROM fill WHERE k = (SELECT max(k) FROM fill)
), t AS (
  SELECT s.source, s.source_size, CASE WHEN is_full THEN cap ELSE s.weight * level END AS target
  FROM s JOIN last ON s.source IS NOT DISTINCT FROM last.source
), r AS (
  SELECT d.*, t.source_size, t.target, floor(coalesce(t.target / nullif(t.source_size, 0), 0) + 1e-12)::BIGINT AS rounds,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (rounds + CASE WHEN run <= target - rounds * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""


def _ablation() -> str:
    mask = quality.mask("v2")
    each = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE failed & {quality.BITS[n]} <> 0) AS n_failed, count(*) FILTER (WHERE failed & {mask} = {quality.BITS[n]}) AS n_only, count(*) AS n_docs FROM q" for n in quality.POLICIES["v2"]]
    return f"WITH q AS ({_OP2}) " + " UNION ALL ".join(each)


def _op12(rounds: int = 3) -> str:
    """Full scans, each assignment a step of common table expressions."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i])))"
    steps = [
        """v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        """c0 AS (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM v ORDER BY h, v LIMIT 16)
)""",
    ]
    for k in range(rounds + 1):
        steps.append(f"d{k} AS (SELECT rid, vec_id, v.v AS v, c, {distance}::BIGINT AS d FROM v CROSS JOIN c{k} AS c)")
        steps.append(f"a{k} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{k} GROUP BY rid)")
        if k < rounds:
            steps.append(f"""c{k + 1} AS (
  SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} AS c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (
      SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{k}, unnest(range(1, 65)) AS u(i) GROUP BY c, i
    ) GROUP BY c
  ) AS m ON m.c = c.c
)""")
    return (
        "WITH " + ",\n".join(steps) + f"""
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, sum(a.d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.c = c.c"""
    )


_OP13 = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::UBIGINT)),
             lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS k
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
  FROM k, unnest(range(0, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS u(copy) WHERE k <> 0
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d
), f AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS former,
         CASE WHEN NOT regexp_matches(text, '[^ \t\n\x0B\f\r]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ \t\n\x0B\f\r]*\z') THEN 't' ELSE '' END AS fault FROM p
), insertion(a, b, n) AS ( -- states: 0 nothing, 1 system, 2 user, 3 assistant
  VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)
), edit(a, b, e, initial, price) AS (
  VALUES (0, 0, 'D', '*', 3), (1, 1, 'D', '*', 3), (2, 2, 'D', '*', 3), (3, 3, 'D', '*', 3),
         (0, 2, 'R', '*', 2), (1, 2, 'R', '*', 2), (2, 3, 'R', '*', 2), (3, 2, 'R', '*', 2),
         (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0)
), inserted(a, n, lines) AS (
  VALUES (0, 0, []::VARCHAR[]), (0, 1, ['user:']), (0, 2, ['user:', 'assistant:']), (1, 0, []), (1, 1, ['user:']), (1, 2, ['user:', 'assistant:']), (2, 0, []), (2, 1, ['assistant:']), (3, 0, []), (3, 1, ['user:'])
), w AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines FROM conversations
  UNION ALL
  SELECT conv_id, i, state, min(cost), arg_min(audit, (cost, audit)), arg_min(lines, (cost, audit)) FROM (
    SELECT w.conv_id, f.i, edit.b AS state, w.cost + 2 * n.n + edit.price + CASE WHEN edit.e <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END AS cost, w.audit || repeat('I', n.n) || edit.e AS audit,
           list_concat(list_concat(w.lines, s.lines), CASE edit.e WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE edit.b WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || f.text] END) AS lines
    FROM w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN insertion AS n ON n.a = w.state JOIN inserted AS s ON s.a = n.a AND s.n = n.n
    JOIN edit ON edit.a = n.b AND (edit.e = 'D' OR f.fault IN ('', 't')) AND edit.initial IN ('*', f.initial)
  ) GROUP BY conv_id, i, state
), z AS (
  SELECT w.conv_id, w.cost + 2 * n.n AS cost, w.audit || repeat('I', n.n) AS audit, list_concat(w.lines, s.lines) AS lines
  FROM w LEFT JOIN (SELECT conv_id, max(i) AS n FROM f GROUP BY conv_id) AS m ON m.conv_id IS NOT DISTINCT FROM w.conv_id
  JOIN insertion AS n ON n.a = w.state AND n.b IN (0, 3) JOIN inserted AS s ON s.a = n.a AND s.n = n.n WHERE w.i = coalesce(m.n, 0)
), best AS (
  SELECT conv_id, min(cost) AS cost, arg_min(audit, (cost, audit)) AS audit, arg_min(lines, (cost, audit)) AS lines FROM z GROUP BY conv_id
), told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
         count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE i > 1 AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM best AS b LEFT JOIN told AS t ON t.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_ledger": _OP2, "op4_ngram_join": _OP4, "op6_source_mix": _OP6, "op12_hamerly_clusters": _op12(), "op13_conversation_repair": _OP13, "quality_ablation": _ablation()}
