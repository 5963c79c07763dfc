"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, embedding_join, language_id, lm_score, mixing, ngram_join, sharding, suffix_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), length=200, with_bytes=False)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_read(spark, sf_dir, "documents"), shards=40)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_read(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_components(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_ids(_read(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.line_tokens(_read(spark, sf_dir, "documents"), rule="majority")


def op9_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_read(spark, sf_dir, "embeddings"), threshold=0.98)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.cross_entropy_difference(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_suffix_dedup, op3_sharding, op4_mixing, op5_ngram_join, op6_language_id, op7_decontamination, op8_token_counts, op9_embedding_join, op10_lm_score)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components as the smallest node that links reach, by recursion over (a, b) in both directions.
_REACH = "reach(node, root) AS (SELECT a, a FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node)"

_OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
 x AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM g),
 i AS (SELECT p.doc_id AS a, q.doc_id AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS c FROM x p JOIN x q ON p.h = q.h AND p.doc_id <> q.doc_id AND p.n >= 0.85 * q.n AND q.n >= 0.85 * p.n GROUP BY 1, 2),
 links AS (SELECT a, b FROM i WHERE 100 * c >= 85 * (na + nb - c)),
 {_REACH}
 SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce((SELECT min(root) FROM reach WHERE node = doc_id), doc_id) AS component_id FROM g"""

_WORD = "'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_OP7 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM documents),
 i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, {_WORD}) AS w FROM benchmark),
 k AS (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0),
 win AS (SELECT DISTINCT item, n, array_to_string(w[k:k+n-1], ' ') AS g FROM k),
 sizes AS (SELECT DISTINCT n FROM win),
 places AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
 o AS (SELECT r, k, n, item FROM (SELECT r, k, n, array_to_string(w[k:k+n-1], ' ') AS g FROM places) JOIN win USING (n, g)),
 h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM o) GROUP BY 1),
 m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM o GROUP BY 1)
 SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
 FROM d LEFT JOIN h USING (r) LEFT JOIN m USING (r)"""

_OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
 ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(x, lambda y: abs(y))) > 0),
 links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
 {_REACH},
 c AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
 SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept FROM v LEFT JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id"""

#: The others learn, sample, place greedily or work on bytes; they are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {"op5_ngram_join": _OP5, "op7_decontamination": _OP7, "op9_embedding_join": _OP9}
