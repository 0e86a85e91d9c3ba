"""Reads over the synced tables (F1-F8, S6-S8, S11, J4-J7): filters pushed into the
scan, joins with the small dimensions broadcast (their size is fixed), sort+limit
as TakeOrderedAndProject.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ts_lit


def filter_source(snapshot: DataFrame, source: str) -> DataFrame:
    """case-insensitive source equality."""
    return snapshot.where(F.lower("source") == F.lower(F.lit(source)))


def paginate(snapshot: DataFrame, offset: int, limit: int) -> DataFrame:
    """rows offset+1 .. offset+limit of the snapshot order."""
    return snapshot.orderBy("pos").offset(offset).limit(limit)


def articles_with_source(articles: DataFrame, sources: DataFrame, source_name: str | None,
                         limit: int = 50, order_by: str = "published_at", ascending: bool = False) -> DataFrame:
    """Articles with their source's name/domain/logo, optionally only one
    source's (inner filter on the source name), ordered and limited."""
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "domain", "logo_url")
    if source_name is not None:
        s = s.where(F.col("source_name") == source_name)
        j = articles.join(s, "source_id")
    else:
        j = articles.join(s, "source_id", "left")
    o = F.asc(order_by) if ascending else F.desc(order_by)
    return (j.orderBy(o, F.asc("id")).limit(limit)
            .select("id", "url", "source_name", "domain",
                    F.date_format(order_by, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("published_at")))


def retention(articles: DataFrame, days: int, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    """(kept, deleted) split at published_at < as_of - days. The kept side is the
    new table snapshot (parquet has no DELETE)."""
    cutoff = as_of - timedelta(days=days)
    old = F.col("published_at") < ts_lit(cutoff)
    return articles.where(~old | F.col("published_at").isNull()), articles.where(old)


def retention_counts(articles: DataFrame, days: int, as_of: datetime) -> DataFrame:
    cutoff = as_of - timedelta(days=days)
    old = F.col("published_at") < ts_lit(cutoff)
    return articles.agg(F.count_if(old).cast("long").alias("deleted"),
                        F.count_if(~old | F.col("published_at").isNull()).cast("long").alias("kept"))


def recent_mentions(mentions: DataFrame, as_of: datetime, days: int = 7, limit: int = 50,
                    company_id: int | None = None) -> DataFrame:
    """created_at >= as_of - days, newest first, limit (optional company)."""
    m = mentions.where(F.col("created_at") >= ts_lit(as_of - timedelta(days=days)))
    if company_id is not None:
        m = m.where(F.col("company_id") == company_id)
    return m.orderBy(F.desc("created_at"), "article_id", "company_id").limit(limit)


def mention_company_ids(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """Ticker -> company id; unknown tickers dropped."""
    c = companies.select(F.col("id").alias("company_id"), "ticker")
    return mentions.join(c, "ticker")


def mentions_enriched(mentions: DataFrame, articles: DataFrame, companies: DataFrame,
                      ticker: str | None = None) -> DataFrame:
    """Mentions with article (id, title, url, published_at) and company columns."""
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company_name"), "ticker")
    a = articles.select(F.col("id").alias("article_id"), F.col("title").alias("article_title"),
                        F.col("url").alias("article_url"), F.col("published_at").alias("article_published_at"))
    # one company's mentions are picked before any article is looked up
    m = (mentions.join(c, "company_id", "left") if ticker is None
         else mentions.join(c.where(F.col("ticker") == ticker), "company_id"))
    return m.join(a, "article_id", "left")


def unanalyzed_articles(articles: DataFrame, mentions: DataFrame, limit: int = 50) -> DataFrame:
    """The newest ``limit`` articles with content, then those without mentions
    (the limit is applied first, so fewer than ``limit`` may come back)."""
    top = (articles.where(F.col("full_content").isNotNull())
           .orderBy(F.desc("published_at"), F.asc("id")).limit(limit)
           .select("id", "url", "title", "full_content", "published_at"))
    analysed = mentions.select(F.col("article_id").alias("id")).join(F.broadcast(top.select("id")), "id",
                                                                    "left_semi")
    return top.join(analysed, "id", "left_anti")
