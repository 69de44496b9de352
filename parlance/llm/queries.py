"""Each operator over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embedding_dedup, licenses, line_dedup, quality, sentencepiece, sharding, simhash, substring_dedup, url_filter

SHARDS = [f"shard-{i:03d}" for i in range(64)]
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, spare=["lang", "source", "n_chars"]).select("doc_id", "slot", "shard")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(licenses.background(docs)))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge_urls(pages, "url", url_filter.rule_table(spark, URL_RULES)).drop("url")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passage_report(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs, model)
    return scored.withColumn("kept", scored.p_above_1 >= model.least_tail())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_sharding, op3_embedding_dedup, op4_license_scan, op5_url_filter, op6_simhash, op7_line_dedup, op8_substring_dedup, op9_quality, op10_decontamination, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reach(u, v) AS (
  SELECT u, v FROM link UNION SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
), least AS (SELECT u, min(v) AS m FROM reach GROUP BY u), degree AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.u = e.vec_id LEFT JOIN least l ON l.u = e.vec_id
""",
    "op5_url_filter": """
WITH p AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(h, s, v) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT q.page_id, h || s AS rule, v, row_number() OVER (PARTITION BY q.page_id ORDER BY length(h || s) DESC, length(h) DESC) AS k
  FROM q JOIN r ON (q.host = h OR ends_with(q.host, '.' || h)) AND starts_with(q.path, s)
)
SELECT q.page_id, q.host, q.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM q LEFT JOIN m ON m.page_id = q.page_id AND m.k = 1
""",
    "op10_decontamination": r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), ds AS (
  SELECT doc_id, greatest(len(w) - 4, 1) AS total, i AS pos, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM d, unnest(range(greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), bs AS (
  SELECT item_id, greatest(len(w) - 4, 1) AS n, array_to_string(w[i + 1:i + 5], ' ') AS s
  FROM b, unnest(range(greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0
), ic AS (SELECT item_id, n, s, count(*) AS c FROM bs GROUP BY ALL
), st AS (
  SELECT DISTINCT ds.doc_id, ic.item_id, ic.n, least(ic.n, ds.total) AS width, least(ds.pos, ds.total - least(ic.n, ds.total)) AS start
  FROM ds JOIN ic USING (s)
), win AS (
  SELECT st.doc_id, st.item_id, st.n, st.width, st.start, ds.s, count(*) AS c
  FROM st JOIN ds ON ds.doc_id = st.doc_id AND ds.pos >= st.start AND ds.pos < st.start + st.width GROUP BY ALL
), sim AS (
  SELECT win.doc_id, win.item_id, win.n, win.width, win.start, sum(least(win.c, ic.c)) AS common
  FROM win JOIN ic ON ic.item_id = win.item_id AND ic.s = win.s GROUP BY ALL
), good AS (
  SELECT doc_id, item_id, CAST(common AS DOUBLE) / (n + width - common) AS similarity, start, width FROM sim
  WHERE CAST(common AS DOUBLE) / (n + width - common) >= 0.8
), best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start DESC) AS k FROM good)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS first_word, CAST(width AS INTEGER) AS shingles FROM best WHERE k = 1
""",
}
