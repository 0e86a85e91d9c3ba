import os
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import ART_SCHEMA, SF001
from feedlens.operators import content, dedup, metrics, upsert
from feedlens.plans import queries as Q
from feedlens.session import checkpoint_dir
from feedlens.sources import dims
from feedlens.sources import tables as S
from feedlens.streaming import ingest as ST


def _root(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex[:8]}"


def test_stream_articles_equals_batch_merge(spark):
    """Three batches whose own orders collide: the table is what one scan over all of them
    in turn keeps, and its order is one order."""
    root = _root(spark)
    arts = S.page_articles(spark, SF001)
    parts = [arts.where(F.col("ord") % 3 == n).withColumn("ord", F.floor(F.col("ord") / 3)) for n in range(3)]
    t = ST.AppendTable(spark, f"{root}/table", ART_SCHEMA + ", batch_ord long")
    for n, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{root}/in/b{n}")
        ST.stream_articles(spark, f"{root}/in/*", arts.schema, t, f"{root}/ck")
    got = t.read().orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(got)))
    every = parts[0].withColumn("_n", F.lit(0)).unionByName(parts[1].withColumn("_n", F.lit(1))).unionByName(parts[2].withColumn("_n", F.lit(2)))
    want = dedup.dedup_articles(every.withColumn("ord", F.struct("_n", "ord"))).select("link", "title", "ord._n", F.col("ord.ord").alias("o"))
    assert [(r.link, r.title, r.batch_ord) for r in got] == [(r.link, r.title, r.o) for r in want.orderBy("_n", "o").collect()]


def test_stream_of_xml_feeds(spark):
    import pyarrow.fs as pafs
    root = _root(spark)
    store, path = pafs.FileSystem.from_uri(root)
    store.create_dir(f"{path}/in", recursive=True)

    def land(name, body):
        with store.open_output_stream(f"{path}/in/{name}") as f:
            f.write(body.encode())
    t = ST.AppendTable(spark, f"{root}/table", ART_SCHEMA + ", batch_ord long")
    run = lambda: ST.stream_xml_articles(spark, f"{root}/in", dims.feed_sources(spark), t, f"{root}/ck", datetime(2024, 2, 1))
    land("feed0.xml", "<rss><channel><item><title>A</title><link>https://x/1</link></item></channel></rss>")
    run()
    land("feed1.xml", "<feed><entry><title>B</title><link href='https://x/2'/></entry>"
                      "<entry><title>A again</title><link href='https://x/1'/></entry></feed>")
    run()
    assert [(r.ord, r.title, r.link) for r in t.read().orderBy("ord").collect()] == [(0, "A", "https://x/1"), (1, "B", "https://x/2")]


def test_stream_daily_metrics_equals_batch(spark):
    got = ST.daily_metrics_via_stream(spark, SF001, "events.parquet", S.events_to_mentions)
    want = metrics.daily_metrics(S.event_mentions(spark, SF001))
    g = {(r.date, r.company_id): (round(r.avg_sentiment, 9), r.article_volume) for r in got.collect()}
    w = {(r.date, r.company_id): (round(r.avg_sentiment, 9), r.article_volume) for r in want.collect()}
    assert g == w


def test_landed_tables_may_be_folders(spark):
    """A table is one file or a folder of part files; both are streamed whole, beside others."""
    root = _root(spark)
    docs = spark.createDataFrame([(i, f"Some news about a company that has a name, number {i}.", "en", "s", 50) for i in range(16)] + [(None, None, None, None, None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{root}/in/documents.parquet")
    spark.range(3).write.parquet(f"{root}/in/labels.parquet")
    q_mentions = Q.QUERIES["stream_company_mentions"]
    got = q_mentions(spark, f"{root}/in")
    one = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/one/documents.parquet")
    fs = one.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    docs.coalesce(1).write.parquet(f"{root}/part")
    part = next(s.getPath() for s in fs.listStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/part")) if s.getPath().getName().endswith(".parquet"))
    fs.mkdirs(one.getParent())
    fs.rename(part, one)
    want = q_mentions(spark, f"{root}/one")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.select("article_id").distinct().count() == 12
    e = spark.read.parquet(f"{SF001}/events.parquet")
    e.repartition(2).write.parquet(f"{root}/in/events.parquet")
    got = ST.daily_metrics_via_stream(spark, f"{root}/in", "events.parquet", S.events_to_mentions)
    assert got.agg(F.sum("article_volume")).first()[0] == e.count()


def test_late_files_count(spark):
    root = _root(spark)
    e = spark.read.parquet(f"{SF001}/events.parquet")
    late = F.dayofmonth("ts") < 20
    e.where(~late).coalesce(1).write.parquet(f"{root}/in/a")
    e.where(late).coalesce(1).write.parquet(f"{root}/in/b")
    got = ST.daily_metrics_via_stream(spark, f"{root}/in/*", "*.parquet", S.events_to_mentions, files_per_trigger=1)
    assert got.agg(F.sum("article_volume")).first()[0] == e.count()
    want = metrics.daily_metrics(S.event_mentions(spark, SF001))
    key = lambda df: sorted((r.date, r.company_id, round(r.avg_sentiment, 9), r.article_volume) for r in df.collect())
    assert key(got) == key(want)


def test_stream_url_dedup_within_watermark(spark):
    root = _root(spark)
    arts = S.page_articles(spark, SF001)
    arts.write.parquet(f"{root}/in")
    s = ST.stream_url_dedup(spark.readStream.schema(arts.schema).parquet(f"{root}/in"))
    q = s.writeStream.format("memory").queryName("dedup_" + uuid.uuid4().hex[:6]).trigger(availableNow=True) \
        .option("checkpointLocation", f"{root}/ck").start()
    q.awaitTermination()
    n = spark.sql(f"select count(*) from {q.name}").first()[0]
    assert n == arts.select(S.F.col("link")).select(__import__("feedlens").functions.text.normalize_url("link")) \
        .distinct().count()


def test_stream_retention(spark):
    root = _root(spark)
    arts = S.page_articles(spark, SF001)
    arts.write.parquet(f"{root}/in")
    t = ST.DayTable(spark, f"{root}/table", ART_SCHEMA)
    as_of = datetime(2024, 1, 3)
    ST.stream_retention(spark, f"{root}/in", arts.schema, t, f"{root}/ck", days=1, as_of=lambda: as_of)
    assert t.read().count() == arts.where(F.col("published_at") >= F.lit(as_of - timedelta(days=1))).count()


def test_stream_company_mentions(spark):
    from feedlens.operators import mentions
    root = _root(spark)
    docs = S.doc_mention_texts(spark, SF001).withColumnRenamed("text", "content")
    docs.write.parquet(f"{root}/in")
    t = ST.MergeTable(spark, f"{root}/table", ST.MENTIONS, ST.MENTIONS_KEY)

    def analyze(df):
        from feedlens.operators import reads
        from feedlens.sources import dims
        a = mentions.analyze_articles(df)
        return reads.mention_company_ids(a, dims.companies(spark)).select(
            F.col("key_pos").alias("ord"), "article_id", "company_id", "sentiment_score", "confidence_score",
            "context_sentence")
    ST.stream_company_mentions(spark, f"{root}/in", docs.schema, t, f"{root}/ck", analyze)
    key = lambda df: sorted((r.article_id, r.company_id, round(r.sentiment_score, 9), r.context_sentence) for r in df.collect())
    want = dedup.fold_mentions(analyze(docs))
    assert want.count() > 0 and key(t.read()) == key(want)


def test_average_sentiment_empty_is_neutral(spark):
    df = spark.createDataFrame([], "negative double, neutral double, positive double, compound double")
    r = metrics.average_sentiment(df).first()
    assert (r.negative, r.neutral, r.positive, r.compound, r.label, r.texts) == (0.0, 1.0, 0.0, 0.0, "neutral", 0)


def test_snapshot_status_ttl_and_update_keeps_clock(spark):
    now = datetime(2024, 2, 1)
    snap = S.page_articles(spark, SF001).withColumn("pos", F.col("ord") + 1) \
        .withColumn("snapshot_ts", F.lit(now - timedelta(seconds=10)))
    assert metrics.snapshot_status(snap, now).first().is_valid
    assert not metrics.snapshot_status(snap, now, ttl_seconds=0).first().is_valid
    empty = snap.limit(0)
    assert not metrics.snapshot_status(empty, now).first().is_valid
    first = snap.orderBy("pos").limit(1).withColumn("content", F.lit("new text")).withColumn(
        "content_extracted", F.lit(True)).drop("pos", "snapshot_ts")
    out = upsert.replace_in_snapshot(snap, first)
    r = out.where(F.col("pos") == 1).first()
    assert r.content == "new text" and r.snapshot_ts == now - timedelta(seconds=10)
    assert out.count() == snap.count()


def test_attach_content_compat_and_retryable(spark):
    arts = S.page_articles(spark, SF001)
    ex = spark.createDataFrame([], "url string, image string, content string")
    c = content.attach_content(arts, ex, compat=True)
    assert c.where("content_extracted").count() == arts.count()
    r = content.attach_content(arts, ex, compat=False)
    assert r.where("content_extracted").count() == 0 and r.where("content_error").count() == arts.count()
    assert os.path.isdir(SF001)


def test_versioned_table_replace_and_clear(spark):
    from feedlens.sources.sinks import VersionedTable
    t = VersionedTable(spark, f"{_root(spark)}/tbl", "k long, v string")
    assert t.latest().count() == 0
    assert t.append_version(spark.createDataFrame([(1, "a")], t.schema)) == 0
    assert t.append_version(spark.createDataFrame([(1, "b"), (2, "c")], t.schema)) == 1
    assert sorted(tuple(r) for r in t.latest().collect()) == [(1, "b"), (2, "c")]
    assert t.clear() == 2 and t.latest().count() == 0
    assert t.latest(before=2).count() == 2
    t.append_version(spark.createDataFrame([(9, "z")], t.schema))
    assert t._versions() == [1, 2, 3]  # the newest three stay


def test_upserted_mentions_keep_their_time(spark):
    store = spark.createDataFrame([(1, 1, 0.1, 0.2, "old", datetime(2024, 1, 1)), (2, 1, 0.1, 0.2, "other", datetime(2024, 1, 2))],
                                  "article_id long, company_id long, sentiment_score double, confidence_score double, "
                                  "context_sentence string, created_at timestamp")
    batch = spark.createDataFrame([(0, 1, 1, 0.9, 0.8, "new", datetime(2024, 1, 9)), (1, 3, 1, 0.5, 0.5, "first", datetime(2024, 1, 9))],
                                  "ord long, article_id long, company_id long, sentiment_score double, confidence_score double, "
                                  "context_sentence string, created_at timestamp")
    got = {r.article_id: r for r in upsert.upsert_mentions(store, batch).collect()}
    assert got[1].created_at == datetime(2024, 1, 1) and got[1].context_sentence == "new" and got[1].sentiment_score == 0.9
    assert got[2].context_sentence == "other" and got[3].created_at == datetime(2024, 1, 9)


def test_one_row_per_article_when_a_page_landed_twice(spark):
    arts = S.page_articles(spark, SF001)
    ex = spark.createDataFrame([(r.link, "https://og", c) for r in arts.collect() for c in (None, "text")], "url string, image string, content string")
    out = content.attach_content(arts, ex)
    assert out.count() == arts.count() and out.where("content = 'text' and image = 'https://og'").count() == arts.count()
