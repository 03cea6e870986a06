"""A corpus from raw documents to packed sequences, one written stage after another."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import minhash_dedup, packing, quality_mcd, suffix_dedup, toxicity_fst
from siltstone.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no robust outliers.  Null and empty texts fail it; a repeated row is judged each time."""
    return quality_mcd.kept_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores under 0.5.  Null and empty texts have no clauses and stay."""
    return toxicity_fst.kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component.  Word-less texts and rows without a doc_id are linked with nothing and stay;
    of several rows with one doc_id the one with the smallest text does."""
    return minhash_dedup.kept_documents(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur again.  A null text comes out empty; other columns stay as they are."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = suffix_dedup.remove_repeats(docs, carry=others)
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[(new[c] if c in new else F.col("rest")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their place in a sequence.  A null or empty text is one piece with the end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("near dedup", near_dedup), ("repeat removal", repeat_removal), ("packing", pack)]

#: SQL can state neither the estimates, the grammar, the tokenizer nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
