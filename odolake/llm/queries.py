"""The registered queries opN_<name> and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    backoff_lm,
    chat_format,
    disclosure,
    embedding_dedup,
    importance_resampling,
    language_id,
    lp_packing,
    ngram_join,
    nra_topk,
    periodic_runs,
    permutation_index,
    secret_scan,
    suffix_pieces,
)
from .common import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(_table(spark, sf_dir, "embeddings"), "id % 50 = 0")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op3_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.round_trip(_table(spark, sf_dir, "documents"))


def op4_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nra_topk.top(_table(spark, sf_dir, "embeddings"), "id % 100 = 0")


OP4_SQL = """
WITH e AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, e.vec_id,
    list_sum([p[1] * p[2] FOR p IN list_zip(q.v, e.v)])::BIGINT AS score
  FROM e AS q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


PROBE = -7


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr(f"{PROBE}L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role").withColumn("text", F.lit(said))
    parts = turns.unionByName(probe).withColumn("parts", chat_format.text_part(F.col("text")))
    return chat_format.digest(chat_format.format_chats(parts))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(replace(replace(replace(role, '\', '\\'), '<', '<\'), chr(10), '<n'))
      + length(replace(replace(text, '\', '\\'), '<', '<\')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op8_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lp_packing.pack(lp_packing.pieces(_table(spark, sf_dir, "documents")))


def op10_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.find(_table(spark, sf_dir, "documents"), context="document"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(_table(spark, sf_dir, "documents"), rewrite=periodic_runs.planted)
    return periodic_runs.digest(found)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH crc AS (
  SELECT [list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS t
), words AS (
  SELECT 0 AS target, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), spelled AS (
  SELECT w, [('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT FOR i IN range(octet_length(encode(w)))] AS bytes
  FROM (SELECT DISTINCT w FROM words)
), hashed AS (
  SELECT w, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket FROM spelled, crc
), counted AS (
  SELECT bucket, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket
), gained AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight
  FROM words JOIN hashed USING (w) JOIN gained USING (bucket) WHERE target = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, n_features >= 20 AS may, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS all_may FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= all_may * 10 // 100 THEN place END AS rank FROM ranked
"""


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


OP13_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
), usable AS (
  SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0
    AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0
), links AS (
  SELECT a.n AS a, a.vec_id AS id, b.n AS b, b.vec_id AS other
  FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.n <> b.n
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT a AS n, id AS least FROM links
  UNION
  SELECT links.b, reach.least FROM reach JOIN links ON links.a = reach.n
), named AS (SELECT n, min(least) AS least FROM reach GROUP BY n),
counted AS (SELECT a AS n, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(least, vec_id)::BIGINT AS component_id,
  vec_id = coalesce(least, vec_id) AS kept
FROM e LEFT JOIN named USING (n) LEFT JOIN counted USING (n)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_permutation_index": op1_permutation_index,
    "op2_ngram_join": op2_ngram_join,
    "op3_suffix_pieces": op3_suffix_pieces,
    "op4_nra_topk": op4_nra_topk,
    "op5_secret_scan": op5_secret_scan,
    "op6_chat_format": op6_chat_format,
    "op7_language_id": op7_language_id,
    "op8_backoff_lm": op8_backoff_lm,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pii_disclosure": op10_pii_disclosure,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_embedding_dedup": op13_embedding_dedup,
}
ORACLE: dict[str, str] = {
    "op4_nra_topk": OP4_SQL,
    "op6_chat_format": OP6_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_embedding_dedup": OP13_SQL,
}
