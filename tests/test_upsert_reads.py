from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF001, make_articles
from feedlens.operators import reads, summarize, upsert
from feedlens.sources import stores
from feedlens.sources import tables as S


def test_dense_ids_follow_order_across_partitions(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("_first"), F.lit("x").alias("v")) \
        .repartition(13)
    out = upsert.assign_dense_ids(df, "_first", 100).select("_first", "id").collect()
    assert sorted((r._first, r.id) for r in out) == [(i, 101 + i) for i in range(3000)]


def test_sources_get_or_create_never_updates_existing(spark):
    existing = spark.createDataFrame([(1, "Old Name", "a.com", 0.9, "logo")], upsert.SOURCES_SCHEMA)
    arts = make_articles(spark, [(3, "t", "https://a.com/x", "New"), (4, "t", "https://b.com/x", "B2"),
                                 (2, "t", "https://b.com/y", "B1")])
    out = {r.domain: r for r in upsert.upsert_sources(existing, arts).collect()}
    assert out["a.com"].name == "Old Name" and out["a.com"].reliability_score == 0.9
    assert out["b.com"].name == "B1" and out["b.com"].id == 2 and out["b.com"].reliability_score == 0.5


def test_articles_upsert_preserves_content_and_sentiment(spark):
    src = spark.createDataFrame([(1, "A", "a.com", 0.5, None)], upsert.SOURCES_SCHEMA)
    store = spark.createDataFrame([(7, "Old", "https://a.com/x", "s", None, datetime(2024, 1, 1), None, "kept body",
                                    1, 0.3)], upsert.ARTICLES_SCHEMA)
    batch = make_articles(spark, [(1, "New", "https://a.com/x", "A"), (2, "Other", "https://a.com/y", "A")])
    out = {r.url: r for r in upsert.upsert_articles(store, src, batch).collect()}
    assert out["https://a.com/x"].title == "New" and out["https://a.com/x"].full_content == "kept body"
    assert out["https://a.com/x"].overall_sentiment == 0.3 and out["https://a.com/x"].id == 7
    assert out["https://a.com/y"].id == 8 and out["https://a.com/y"].source_id == 1


def test_update_sentiment_is_update_only(spark):
    store = stores.articles_store(spark, SF001)
    scores = spark.createDataFrame([("https://nowhere/x", 0.5, 1)], "url string, compound double, ord long")
    out = upsert.update_sentiment(store, scores)
    assert out.count() == store.count() and out.where(F.col("overall_sentiment").isNotNull()).count() == 0


def test_unanalyzed_limit_applies_before_exclusion(spark):
    arts = spark.createDataFrame([(i, f"u{i}", "t", "body", datetime(2024, 1, 1, i)) for i in range(1, 6)],
                                 "id long, url string, title string, full_content string, published_at timestamp")
    ments = spark.createDataFrame([(5,), (4,)], "article_id long")
    out = sorted(r.id for r in reads.unanalyzed_articles(arts, ments, limit=3).collect())
    assert out == [3]


def test_matrix_summaries_pick_sentences_in_order(spark):
    d = S.table(spark, SF001, "documents").select("doc_id", "text").limit(40)
    for algo in ("textrank", "lexrank", "lsa"):
        out = summarize.configure_summarizer(algo).summarize(d, "doc_id", "text", 200).collect()
        for r in out:
            if r.text is None or len(r.text.strip()) < summarize.MIN_CHARS:
                assert r.summary == r.text
                continue
            import re
            sents = re.split(r"(?<=[.!?])\s+", r.text)
            rest, used = r.summary, 0
            for s in sents:  # the summary is a subsequence of the sentences, joined by spaces
                if rest == s or rest.startswith(s + " "):
                    rest, used = rest[len(s) + 1:], used + 1
            assert rest == "" and 0 < used <= summarize.sentence_count(200)


def test_unknown_summarizer_raises():
    import pytest
    with pytest.raises(ValueError):
        summarize.configure_summarizer("gpt")
