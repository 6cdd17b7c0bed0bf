"""One query for each operator, and its SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pangrove.llm import decontaminate, embeddings, mixing, quality, simhash, substrings, tokens, toxicity, url_filters

BPE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), length=1024, end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(BPE), limit=512)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"), words=4, radius=4, seed=42)


RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_filters.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_groups(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, _table(spark, sf_dir, "labels")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(_table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_token_counts": op2_token_counts,
    "op3_simhash": op3_simhash,
    "op4_url_filters": op4_url_filters,
    "op5_mixing": op5_mixing,
    "op6_embeddings": op6_embeddings,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_substrings": op9_substrings,
    "op10_decontaminate": op10_decontaminate,
    "pipeline": corpus_pipeline.run,
}

_HOST = """CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END"""
_PATH = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"

SQL: dict[str, str] = {
    "op4_url_filters": f"""
WITH rules(rhost, rpath, action) AS (VALUES {", ".join(map(str, RULES))}),
urls AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages),
distinct_urls AS (SELECT DISTINCT host, path FROM urls),
best AS (
  SELECT u.host, u.path, arg_max(rhost || rpath, length(rhost || rpath) * 1000 + length(rhost)) AS rule,
         arg_max(action, length(rhost || rpath) * 1000 + length(rhost)) AS action
  FROM distinct_urls u JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)
  GROUP BY 1, 2)
SELECT page_id, u.host, u.path, b.rule, coalesce(b.action, 'allow') AS verdict
FROM urls u LEFT JOIN best b ON u.host = b.host AND u.path = b.path""",
    "op6_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, to_id) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a),
comp AS (SELECT id, min(to_id) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN comp c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op5_mixing": r"""
WITH sizes AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^ 	-
]+')) END::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, ([5, 2, 1])[(rank - 1) % 3 + 1]::BIGINT AS weight, source_size * 3 AS lim FROM r),
l AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT - coalesce(sum(lim) OVER o, 0)::BIGINT)::DOUBLE
            / ((sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER o, 0)::BIGINT)::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT arg_min(level, struct_pack(a := lim / weight, b := rank)) AS water FROM l WHERE level * weight <= lim),
t AS (
  SELECT source, source_size, least(lim::DOUBLE, water * weight) AS target,
         (('0x' || substr(md5('7:' || source), 1, 3))::INT::DOUBLE + 0.5) / 4096.0 AS u
  FROM l, water),
d AS (
  SELECT z.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS step,
         (row_number() OVER (PARTITION BY z.source ORDER BY z.size, z.doc_id) - 1)::DOUBLE AS k
  FROM sizes z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(u + step * (k + 1)) - floor(u + step * k))::BIGINT * size)::BIGINT AS taken,
       source, (floor(u + step * (k + 1)) - floor(u + step * k))::BIGINT AS copies
FROM d""",
}
