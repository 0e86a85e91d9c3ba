"""One query per corpus operator: each applies it, with production parameters, to the whole
of its table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, langid, lm, manifest, merkle, mixing, quality, search, simhash, spans, tokens, warc
from .common import load


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.length_histogram(load(spark, sf_dir, "documents"))


def op3_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.dedup_report(load(spark, sf_dir, "documents"))


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(load(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(load(spark, sf_dir, "embeddings"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(load(spark, sf_dir, "documents"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(load(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(load(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op13_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_mix_sources, op2_token_counts, op3_span_dedup, op4_merkle_fingerprint, op5_simhash_groups,
    op6_nearest_neighbours, op7_language_id, op8_lm_score, op9_pack_sequences, op10_warc_round_trip,
    op11_ranked_search, op12_quality_rules, op13_dataset_manifest)}

ORACLE: dict[str, str] = {"op1_mix_sources": mixing.ORACLE, "op3_span_dedup": spans.ORACLE,
                          "op4_merkle_fingerprint": merkle.ORACLE, "op10_warc_round_trip": warc.ORACLE,
                          "op11_ranked_search": search.ORACLE, "op12_quality_rules": quality.ORACLE, "op13_dataset_manifest": manifest.ORACLE}
