"""The registered queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, host_extract, kd_shards, line_dedup, mixing, multi_index, ngram_jaccard, packed_products, prefix_trie, quality_rules, recompression, secret_scan, toxicity

#: The vocabulary file of a public tokenizer; operators take it as a parameter.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class LlmQuery:
    plan: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_groups(table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(table(spark, sf_dir, "documents"))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op9_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.remove_repeats(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


# CRC-32 is folded bit by bit; nodes are named by the digests of their turns.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
digests AS (
  SELECT c, turn, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32) AS d,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM turns),
ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS r FROM digests),
steps AS (
  SELECT DISTINCT c, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS bits FROM ranked),
convs AS (
  SELECT c, c - c % 20 AS b, xor(list_reduce(list_concat([4294967295::BIGINT], bits),
    lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 4 AS h FROM steps),
heads AS (SELECT v.c, t.r AS depth, t.d, t.w FROM convs v JOIN ranked t ON t.c = v.b AND t.r <= v.h),
sizes AS (SELECT v.c, v.h, count(x.c) AS n FROM convs v LEFT JOIN heads x ON x.c = v.c GROUP BY v.c, v.h),
rebuilt AS (
  SELECT * FROM heads UNION ALL
  SELECT t.c, t.r - s.h + s.n, t.d, t.w FROM ranked t JOIN sizes s ON s.c = t.c AND t.r > s.h),
members AS (
  SELECT c, depth, string_agg(d, '') OVER (PARTITION BY c ORDER BY depth) AS path, w FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs),
lengths AS (SELECT c, max(depth) AS depth FROM members GROUP BY c),
ending AS (
  SELECT m.path, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS ids FROM members m JOIN lengths l ON l.c = m.c AND l.depth = m.depth GROUP BY m.path),
nodes AS (SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, min(w) AS w FROM members GROUP BY path, depth),
children AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.path = n.path),
sums AS (
  SELECT a.path, sum((b.n_children = 0)::BIGINT) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved_tokens
  FROM full_nodes a JOIN full_nodes b ON starts_with(b.path, a.path) GROUP BY a.path)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path LEFT JOIN ending e ON e.path = n.path
LEFT JOIN nodes p ON n.depth > 0 AND p.path = substr(n.path, 1, length(n.path) - 32) AND p.depth = n.depth - 1
"""


def op12_host_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_extract.main_texts(table(spark, sf_dir, "pages"))


def op13_packed_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.where(packed_products.usable(F.col("label"), F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), packed_products.quantised(F.col("embedding"), 256).alias("parts"))
    return packed_products.hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS parts
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_dot_product(a.parts, b.parts)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 100 * s.score BETWEEN 30 * p.positive_score AND 90 * p.positive_score
QUALIFY rank <= 10
"""

QUERIES: dict[str, LlmQuery] = {
    "op1_ngram_jaccard": LlmQuery(op1_ngram_jaccard),
    "op2_bpe_codec": LlmQuery(op2_bpe_codec),
    "op3_mixing": LlmQuery(op3_mixing),
    "op4_secret_scan": LlmQuery(op4_secret_scan),
    "op5_quality_rules": LlmQuery(op5_quality_rules),
    "op6_kd_shards": LlmQuery(op6_kd_shards),
    "op7_multi_index": LlmQuery(op7_multi_index),
    "op8_line_dedup": LlmQuery(op8_line_dedup),
    "op9_recompression": LlmQuery(op9_recompression),
    "op10_toxicity": LlmQuery(op10_toxicity),
    "op11_prefix_trie": LlmQuery(op11_prefix_trie, OP11_SQL),
    "op12_host_extract": LlmQuery(op12_host_extract),
    "op13_packed_negatives": LlmQuery(op13_packed_negatives, OP13_SQL),
}
