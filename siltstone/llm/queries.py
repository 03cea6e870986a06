"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import ann_kdtree, bpe_dp, hard_negatives, minhash_dedup, mips_buckets, packing, periodic_runs, preference_chat, quality_mcd, suffix_dedup, token_binary, toxicity_fst, wordpiece_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.robust_outliers(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op2_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_dp.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_fst.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_projected_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_kdtree.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_binary.written_and_read(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("text")


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return preference_chat.preference_pairs(chosen, preference_chat.stale_reply(turns))


def op11_segment_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label).drop("scored")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op13_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mips_buckets.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_mcd, op2_wordpiece_counts, op3_bpe_prefix_dp, op4_toxicity_grammar, op5_projected_kdtree, op6_token_binary, op7_best_fit_packing, op8_minmax_near_dedup, op9_repeat_removal, op10_preference_pairs, op11_segment_hard_negatives, op12_periodic_runs, op13_top_products)
}

_ROWS = "SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"
_SCORE = "CAST(list_dot_product(q.v, c.v) AS BIGINT)"

_TOP_SQL = f"""
WITH r AS ({_ROWS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, {_SCORE} AS score FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5"""

_HARD_SQL = f"""
WITH r AS (SELECT vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM ({_ROWS}) WHERE label IS NOT NULL),
s AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, {_SCORE} AS score FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score WHERE place <= 5)
SELECT * FROM n WHERE rank <= 10"""

#: Only what SQL states exactly; the rest is tested against brute force in tests/llm.
ORACLE_SQL = {"op10_preference_pairs": preference_chat.STALE_REPLY_SQL, "op11_segment_hard_negatives": _HARD_SQL, "op13_top_products": _TOP_SQL}
