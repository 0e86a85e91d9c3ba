"""Synced tables (sources, articles, company_mentions, daily metrics) as Spark
derives them from the driver's tables with the package's own upserts.

On a cluster these are parquet snapshots in the warehouse; here each is rebuilt from
the landed tables so every query's work grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import upsert as U
from . import dims
from . import tables as S


def page_batch(spark: SparkSession, sf: str, content_mod: int = 3) -> DataFrame:
    """page articles whose content is known for page_id % content_mod != 0."""
    a = S.page_articles(spark, sf)
    return a.withColumn("content", F.when(F.col("ord") % content_mod != 0, F.col("description")))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def sources_store(spark: SparkSession, sf: str) -> DataFrame:
    return U.upsert_sources(empty(spark, U.SOURCES_SCHEMA), S.page_articles(spark, sf))


def articles_store(spark: SparkSession, sf: str) -> DataFrame:
    src = sources_store(spark, sf)
    return U.upsert_articles(empty(spark, U.ARTICLES_SCHEMA), src, page_batch(spark, sf))


def mentions_store(spark: SparkSession, sf: str) -> DataFrame:
    """company_mentions after upserting the event mention batch."""
    store = empty(spark, "article_id long, company_id long, sentiment_score double, "
                         "confidence_score double, context_sentence string, created_at timestamp")
    return U.upsert_mentions(store, S.event_mentions(spark, sf))


def companies(spark: SparkSession) -> DataFrame:
    return dims.companies(spark)
