"""The opN_ queries and the corpus pipeline, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quarrylens.llm import oracle
from quarrylens.llm.byte_bpe import bpe_digests
from quarrylens.llm.langid import language_id
from quarrylens.llm.lexical_bisect import lexical_search
from quarrylens.llm.minhash_mih import minhash_near_dedup
from quarrylens.llm.norm_pq import vector_codes
from quarrylens.llm.pii_weak import pii_scan
from quarrylens.llm.pivot_topk import pivot_topk
from quarrylens.llm.quality_rules import quality_rules
from quarrylens.llm.quality_weak import quality_classifier
from quarrylens.llm.secret_ledger import named_ledger, secret_scan
from quarrylens.llm.sentencepiece_nbest import encode_documents
from quarrylens.llm.source_mix import source_mix, source_targets, word_count
from quarrylens.llm.suffix_dedup import suffix_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"), n=2)


def op3_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_topk(_table(spark, sf_dir, "embeddings"))


def op4_pii_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_scan(_table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"), named_ledger(spark, f"{sf_dir}/documents.parquet"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_near_dedup(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(_table(spark, sf_dir, "documents"))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op4, which SQL can express."""
    return op4_pii_weak(spark, sf_dir).drop("spans")


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op6's sources, which SQL can express."""
    docs = _table(spark, sf_dir, "documents")
    return source_targets(docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_pivot_topk": op3_pivot_topk,
        "op4_pii_weak": op4_pii_weak,
        "op5_secret_ledger": op5_secret_ledger,
        "op6_source_mix": op6_source_mix,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_quality_classifier": op9_quality_classifier,
        "op10_language_id": op10_language_id,
        "op11_vector_codes": op11_vector_codes,
        "op12_lexical_search": op12_lexical_search,
        "op13_byte_bpe": op13_byte_bpe,
        "pii_base": pii_base,
        "mix_sources": mix_sources,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = oracle.oracle_sql()
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
