"""End-to-end flows of the service composed from the operators.

* ``aggregate_snapshot`` — §3.1: entries -> normalize -> greedy dedup -> newest first
  -> cap 200 (with ``pos`` and the snapshot time).
* ``sync_all`` — §3.2: snapshot -> pages for the articles that need content ->
  sources/articles upsert -> sentiment update -> mentions (content only) -> mention
  upsert -> metrics for the touched (day, company) pairs.
* ``analyze_companies`` — §3.3: mention analysis of article texts + per-company summary.

Each step is a DataFrame transform; the caller decides where tables are written
(``sources.sinks.VersionedTable``). Nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_fallback
from ..operators import content, dedup, mentions, metrics, normalize, reads, scoring
from ..operators import upsert as U
from ..session import cut_lineage, ts_lit
from ..sources import dims


def collect_articles(entries: DataFrame, sources: DataFrame, as_of: datetime, sitemap: DataFrame | None = None,
                     redirects: DataFrame | None = None, per_feed: int | None = None) -> DataFrame:
    """§3.1, first half: feed entries and sitemap items normalized, aggregator links decoded,
    united and deduplicated (D4). Nothing is capped unless ``per_feed`` is given."""
    arts = normalize.normalize_entries(entries, sources, as_of, per_feed)
    if redirects is not None:
        arts = normalize.resolve_redirects(arts, redirects, sources)
    if sitemap is not None:
        arts = arts.unionByName(normalize.normalize_sitemap(sitemap, sources.where("is_sitemap"), as_of, per_feed))
    return dedup.dedup_articles(arts)


def aggregate_snapshot(entries: DataFrame, sources: DataFrame, as_of: datetime,
                       cap: int = dims.MAX_TOTAL_ARTICLES, sitemap: DataFrame | None = None,
                       redirects: DataFrame | None = None, per_feed: int | None = dims.MAX_ARTICLES_PER_FEED) -> DataFrame:
    """§3.1 without the network; ``cap`` and ``per_feed`` are the service's own limits."""
    arts = collect_articles(entries, sources, as_of, sitemap, redirects, per_feed)
    top = arts.orderBy(F.desc("published_at"), F.asc("ord")).limit(cap)
    w = Window.orderBy(F.desc("published_at"), F.asc("ord"))  # over <= cap rows
    return (top.withColumn("pos", F.row_number().over(w).cast("long"))
            .withColumn("snapshot_ts", ts_lit(as_of)))


@dataclass
class SyncResult:
    snapshot: DataFrame
    sources: DataFrame
    articles: DataFrame
    mentions: DataFrame
    metrics: DataFrame


def sync_all(snapshot: DataFrame, pages: DataFrame, sources: DataFrame, articles: DataFrame,
             mention_store: DataFrame, metric_store: DataFrame, companies: DataFrame,
             as_of: datetime, extract_limit: int | None = None,
             scorer: scoring.Scorer | None = None) -> SyncResult:
    """§3.2. ``pages`` are the landed pages (url, html) of this run. Every step's
    result is checkpointed to the shared folder, as the service writes a table after
    each step: plans stay small and a lost executor reruns one step only. All landed pages
    that are needed are extracted unless ``extract_limit`` says otherwise (the service's
    limit paces its fetches)."""
    snapshot = cut_lineage(snapshot)
    # 2-3: extract content for articles without stored content
    todo = content.needs_content(snapshot, articles, extract_limit)
    pages_needed = pages.join(todo.select(F.col("link").alias("url")), "url", "left_semi")
    extracted = content.attach_content(todo.drop("pos"), content.extract_pages(pages_needed))
    snap = cut_lineage(U.replace_in_snapshot(snapshot, extracted))
    # 4: sources + articles upsert
    new_sources = cut_lineage(U.upsert_sources(sources, snap))
    new_articles = cut_lineage(U.upsert_articles(articles, new_sources, snap))
    # 5-6: sentiment of each snapshot article, update-only
    texts = snap.select(F.col("link").alias("url"), "ord",
                        text_fallback("content", "description", "title").alias("text"))
    scored = scoring.sentiment(texts, "text", scorer)
    new_articles = cut_lineage(U.update_sentiment(new_articles, scored))
    # 7: mentions for snapshot articles with content (content only, no title)
    with_ids = (snap.where(F.col("content").isNotNull())
                .join(new_articles.select(F.col("url").alias("link"), F.col("id").alias("article_id")), "link"))
    found = cut_lineage(mentions.analyze_text(with_ids.select("article_id", F.col("content").alias("text")),
                                              scorer=scorer))
    rows = (reads.mention_company_ids(found, companies)
            .select(F.col("key_pos").alias("ord"), "article_id", "company_id", "sentiment_score",
                    F.col("confidence_score"), F.left("context_sentence", F.lit(dims.CONTEXT_MAX_CHARS))
                    .alias("context_sentence"), ts_lit(as_of).alias("created_at")))
    new_mentions = cut_lineage(U.upsert_mentions(mention_store, rows.select(
        "ord", *[c for c in mention_store.columns])))
    # 8: metrics for the touched (day, company) pairs; the day is that of the stored mention,
    # which an upsert leaves where it was
    batch_keys = rows.select("article_id", "company_id").distinct()
    touched = (new_mentions.join(batch_keys, ["article_id", "company_id"], "left_semi")
               .select("company_id", F.to_date("created_at").alias("_d")).distinct())
    days = new_mentions.withColumn("_d", F.to_date("created_at"))
    scope = days.join(touched, ["company_id", "_d"], "left_semi").drop("_d")
    new_metrics = U.upsert(metric_store, metrics.daily_metrics(scope), ["date", "company_id"])
    return SyncResult(snap, new_sources, new_articles, new_mentions, new_metrics)


def analyze_companies(articles: DataFrame, scorer: scoring.Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """§3.3: (mentions per article, per-company summary)."""
    found = mentions.analyze_articles(articles, scorer=scorer)
    return found, metrics.company_summary(found)
