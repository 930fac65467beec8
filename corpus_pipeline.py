"""A corpus pipeline over `documents`: language ID, exact and near deduplication, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidence_spark.llm import exact_dedup, langid, near_dedup, packing
from evidence_spark.llm.common import materialize, table
from evidence_spark.llm.queries import tokenizer


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, null, empty and letterless texts, go. Every other row stays, repeated rows and rows without a
    doc_id too; the model learns from the rows with a label, and without any row or label nothing changes but that."""
    return langid.keep_identified(docs, langid.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space alone, the one with the smallest doc_id stays; rows that repeat its doc_id stay with
    it, rows without a doc_id only where no row of the group has one. An empty table stays empty."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; rows that repeat a doc_id stay or go
    together, rows without one stay. An empty table stays empty."""
    return near_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, by sequence. Null texts count as empty; rows that repeat a doc_id, or have none, are documents of
    their own. An empty table gives no pieces."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: Tokenizing and MinHash have no SQL; tests/llm/test_set_operators.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
