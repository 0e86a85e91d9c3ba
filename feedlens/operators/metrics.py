"""Aggregations (A1-A9): sentiment averages, company summaries, daily metrics, run
and snapshot status. All are hash aggregates with map-side partial aggregation, so a
hot company or source is combined before the shuffle; "first k" lists are ranked
with ``row_number() <= k`` (Spark inserts a partial WindowGroupLimit before the
shuffle) and only then collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ts_lit


def label_of_compound(c) -> F.Column:
    return (F.when(c >= 0.05, "positive").when(c <= -0.05, "negative").otherwise("neutral"))


def average_sentiment(scored: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A1: means of the three probabilities and of compound; label by +-0.05 on
    compound. A global average over no rows is neutral (0, 1, 0, 0)."""
    aggs = [F.avg("negative").alias("negative"), F.avg("neutral").alias("neutral"),
            F.avg("positive").alias("positive"), F.avg("compound").alias("compound"),
            F.count(F.lit(1)).alias("texts")]
    out = scored.groupBy(*(group or [])).agg(*aggs)
    if not group:
        out = out.select(F.coalesce("negative", F.lit(0.0)).alias("negative"),
                         F.coalesce("neutral", F.lit(1.0)).alias("neutral"),
                         F.coalesce("positive", F.lit(0.0)).alias("positive"),
                         F.coalesce("compound", F.lit(0.0)).alias("compound"), "texts")
    return out.withColumn("label", label_of_compound(F.col("compound")))


def newest_per_group(df: DataFrame, group: str, n: int, order=("published_at", "ord")) -> DataFrame:
    """Top n newest rows of each group (stable on ``ord``)."""
    w = Window.partitionBy(group).orderBy(F.desc(order[0]), F.asc(order[1]))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sentiment_report(scored: DataFrame, group: str = "source") -> DataFrame:
    """A2: per source, number of articles analysed, average compound rounded to 4
    places and the label of the unrounded average."""
    return (scored.groupBy(group)
            .agg(F.count(F.lit(1)).alias("articles_analyzed"), F.avg("compound").alias("_avg"))
            .select(group, "articles_analyzed", F.round("_avg", 4).alias("average_compound"),
                    label_of_compound(F.col("_avg")).alias("overall_label")))


def company_summary(mentions: DataFrame, order=("article_id", "key_pos"), k: int = 5) -> DataFrame:
    """A3: per ticker counts, sentiment total/average, label counts (other labels count
    as neutral) and the first k contexts (cut to 200 chars) in mention order."""
    stats = mentions.groupBy("ticker").agg(
        F.min_by("company_name", F.struct(*order)).alias("company_name"),
        F.count(F.lit(1)).alias("mention_count"),
        F.sum("sentiment_score").alias("total_sentiment"),
        F.count_if(F.col("sentiment_label") == "positive").alias("positive_count"),
        F.count_if(F.col("sentiment_label") == "negative").alias("negative_count"),
        F.count_if(~F.col("sentiment_label").isin("positive", "negative")).alias("neutral_count"))
    w = Window.partitionBy("ticker").orderBy(*[F.asc(c) for c in order])
    first = (mentions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
             .groupBy("ticker").agg(F.array_join(F.transform(
                 F.array_sort(F.collect_list(F.struct("_rn", F.left("context_sentence", F.lit(200)).alias("c")))),
                 lambda s: s["c"]), "|").alias("contexts")))
    return (stats.join(first, "ticker")
            .withColumn("avg_sentiment", F.col("total_sentiment") / F.col("mention_count")))


def daily_metrics(mentions: DataFrame, compat: bool = False) -> DataFrame:
    """A4: per (UTC day, company) average sentiment and volume. ``compat`` reproduces
    the service's window [00:00:00, 23:59:59), which leaves out the last second."""
    m = mentions
    if compat:
        sec = F.hour("created_at") * 3600 + F.minute("created_at") * 60 + F.second("created_at")
        m = m.where(sec < 86399)
    return (m.groupBy(F.to_date("created_at").alias("day"), "company_id")
            .agg(F.avg("sentiment_score").alias("avg_sentiment"), F.count(F.lit(1)).alias("article_volume"))
            .select(F.date_format("day", "yyyy-MM-dd").alias("date"), "company_id", "avg_sentiment",
                    "article_volume"))


def company_metric_series(metrics: DataFrame, companies: DataFrame, ticker: str, days: int,
                          as_of: datetime) -> DataFrame:
    """One company's rows of the last ``days`` days, newest first."""
    cutoff = (as_of.date().toordinal() - days)
    cutoff_s = datetime.fromordinal(cutoff).strftime("%Y-%m-%d")
    comp = F.broadcast(companies.where(F.col("ticker") == ticker).select(F.col("id").alias("company_id"),
                                                                           "name", "ticker"))
    return (metrics.join(comp, "company_id").where(F.col("date") >= cutoff_s)
            .orderBy(F.desc("date")))


def article_company_counts(mentions: DataFrame) -> DataFrame:
    """Distinct companies and total mentions per article."""
    return mentions.groupBy("article_id").agg(F.count_distinct("ticker").alias("companies_found"),
                                              F.count(F.lit(1)).alias("total_mentions"))


def run_result(status: DataFrame) -> DataFrame:
    """Total articles, feeds fetched/failed, success iff failed < fetched, errors."""
    return status.agg(
        F.sum("articles").alias("total_count"), F.count(F.lit(1)).alias("sources_fetched"),
        F.count_if(F.col("error").isNotNull()).alias("sources_failed"),
        F.array_join(F.transform(F.array_sort(F.collect_list(
            F.when(F.col("error").isNotNull(), F.struct("feed_ord", "error")))), lambda s: s["error"]), "\n")
        .alias("errors")).withColumn("success", F.col("sources_failed") < F.col("sources_fetched"))


def snapshot_status(snapshot: DataFrame, as_of: datetime, ttl_seconds: int = 300) -> DataFrame:
    """Article count, age of the snapshot and whether it is still valid (non-empty
    and age <= TTL)."""
    age = F.unix_timestamp(ts_lit(as_of)) - F.unix_timestamp(F.max("snapshot_ts"))
    return snapshot.agg(F.count(F.lit(1)).alias("articles_in_cache"), age.alias("cache_age_seconds")) \
        .withColumn("is_valid", (F.col("articles_in_cache") > 0) & (F.col("cache_age_seconds") <= ttl_seconds))
