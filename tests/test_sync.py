from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF001
from feedlens.operators import upsert as U
from feedlens.plans import sync
from feedlens.sources import dims, feeds, stores
from feedlens.sources import tables as S

AS_OF = datetime(2024, 2, 1)


def test_sync_all_end_to_end_and_rerun_is_stable(spark):
    snap = sync.aggregate_snapshot(feeds.raw_items_from_pages(spark, SF001), dims.feed_sources(spark), AS_OF)
    assert snap.count() > 0 and snap.select("pos").distinct().count() == snap.count()
    mstore = stores.empty(spark, "article_id long, company_id long, sentiment_score double, "
                                 "confidence_score double, context_sentence string, created_at timestamp")
    metr = stores.empty(spark, "date string, company_id long, avg_sentiment double, article_volume long")
    r = sync.sync_all(snap, S.page_fixture(spark, SF001), stores.empty(spark, U.SOURCES_SCHEMA),
                      stores.empty(spark, U.ARTICLES_SCHEMA), mstore, metr, dims.companies(spark), AS_OF)
    n = r.articles.count()
    assert n == snap.count() == r.articles.select("url").distinct().count()
    assert r.articles.where(F.col("overall_sentiment").isNotNull()).count() == n
    assert r.snapshot.where("content_extracted").count() > 0
    r2 = sync.sync_all(snap, S.page_fixture(spark, SF001), r.sources, r.articles, r.mentions, r.metrics,
                       dims.companies(spark), AS_OF)
    assert r2.articles.count() == n and r2.sources.count() == r.sources.count()
    assert sorted(x.id for x in r2.articles.collect()) == sorted(x.id for x in r.articles.collect())


def test_analyze_companies(spark):
    docs = S.doc_mention_texts(spark, SF001).withColumnRenamed("text", "content")
    found, summary = sync.analyze_companies(docs)
    assert found.count() > 0
    s = {r.ticker: r for r in summary.collect()}
    assert "NVDA" in s and s["NVDA"].mention_count == found.where(F.col("ticker") == "NVDA").count()
