"""From raw documents to token ids in five stages, each an operator of quarrylens.llm over all its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns of any name; what
comes of them is stated below and in the operator's module.  An empty table gives an empty result in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm._common import Scratch, discard, written
from quarrylens.llm.minhash_mih import near_dedup_filter
from quarrylens.llm.quality_rules import quality_filter
from quarrylens.llm.secret_ledger import named_ledger, redact_secrets
from quarrylens.llm.sentencepiece_nbest import encode_documents
from quarrylens.llm.source_mix import mix_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null or blank text is rejected; repeated rows stay or go together; other columns play no part, null or not.
    """
    return quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of a similarity of 0.8 or more, stays: the one of the least doc_id.

    Blank texts are no copies and stay; rows without a doc_id stay; of repeated rows one stays; rows that share a doc_id but
    not their shingles are judged each for itself.
    """
    return near_dedup_filter(docs, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a mask; n_chars follows.  All rows stay; a null text stays null, with a null n_chars."""
    kind = docs.schema["n_chars"].dataType
    ledger = named_ledger(spark, f"{sf_dir}/documents.parquet")  # texts that op5 has scanned are not scanned again
    return redact_secrets(docs, ledger=ledger).withColumn("n_chars", F.length("text").cast(kind))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it, two times at most.

    A null source is a source of its own; blank texts have no words and stay once; repeated rows share what their group takes.
    """
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the best segmentation, with the scores and ids of the two best; one row each row.

    A null text has null ids and 0 tokens, an empty one no tokens; texts are encoded whole, however long.
    """
    return encode_documents(docs, n=2, keep=("doc_id", "source"))


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("secret_scan", secrets), ("source_mix", mix), ("sentencepiece", tokens)]

#: SentencePiece search and connected components have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next.

    What a stage wrote on its way, and its input, is deleted as soon as its output is written; the input of the last stage is left.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with Scratch() as scratch:
            after = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.discard(after)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
