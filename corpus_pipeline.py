"""The corpus pipeline: documents -> one language-checked, deduplicated, mixed and packed
training set. Every stage takes (spark, docs, sf_dir), works on all that its predecessor
kept and returns a DataFrame that is written as Parquet and read again as the next one's
``docs``; all but the last return the columns of ``documents``.

In every stage a null or empty text is a text without words or letters (the language stage
drops it), rows that share a doc_id or are repeated are documents each (near duplicates of
each other), ties go to the smaller doc_id or name, an empty table gives an empty table and
further columns are kept up to the last stage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from feedlens.llm import langid, mixing, simhash, spans, tokens
from feedlens.llm.common import load, ready
from feedlens.session import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    ready(spark)
    return langid.keep_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    ready(spark)
    return simhash.keep_one(docs)


def span_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that repeat go."""
    ready(spark)
    return spans.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or cut to their target weights."""
    ready(spark)
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded documents in sequences of at most 1024 ids."""
    ready(spark)
    return tokens.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("span_dedup", span_dedup), ("mix", mix), ("pack", pack)]

# Encoding and fingerprints have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = load(spark, sf_dir, "documents")
    at = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{at}/{k}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(out)
        docs = spark.read.schema(result.schema).parquet(out)
    return docs
