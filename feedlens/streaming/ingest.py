"""Structured Streaming forms of the pipeline.

The service polls its feeds every few minutes; here landed files are a file-source
stream processed with ``trigger(availableNow=True)`` (or a processing-time trigger
in production). What a micro-batch reads and writes follows the batch, not the table: the
article table only grows (micro-batch ``n`` writes ``<table>/v=<n>``) and knows its keys by an
index with Bloom filters; tables that change (metric sums, mentions) merge on read and get
the touched rows only; the retention table drops whole days. Batch ``n`` writes version ``n``
everywhere, so a retried batch rewrites its own folders (idempotent), and a lost executor
only reruns tasks. Checkpoints and tables live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_url
from ..operators import dedup, normalize
from ..operators import upsert as U
from ..session import checkpoint_dir, cut_lineage
from ..sources import feeds
from ..sources.keyindex import KeyIndex
from ..sources.merge import MergeTable
from ..sources.sinks import AppendTable, DayTable, VersionedTable


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/feedlens-{name}-{uuid.uuid4().hex[:8]}"


def _run(writer, once: bool = True):
    q = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
    if once:
        q.awaitTermination()
    return q


def key_digests(keys: DataFrame) -> DataFrame:
    """Both key digests of ``dedup.dedup_keys`` as one column."""
    return keys.select("uk").unionByName(keys.select(F.col("tk").alias("uk")))


def append_new(table: AppendTable, articles: DataFrame, epoch: int) -> None:
    """D5 for a micro-batch: existing rows first, then the batch's, then D4. The table is clean
    already, so only the batch is deduplicated; which of its keys are known the table's index
    says. Kept rows get ``ord`` after all stored ones, in the batch's order, so the table keeps
    one order over all batches; ``batch_ord`` is their own."""
    spark = table.spark
    index = KeyIndex(spark, f"{table.path}-keys")
    ends = VersionedTable(spark, f"{table.path}-last", "last long")
    if not ends._versions() and table._versions():      # a table from before it had an index
        old = table.read(before=epoch)
        index.add(key_digests(dedup.dedup_keys(old)), -1)
        ends.write(old.agg(F.max("ord").alias("last")), -1)
    keys = cut_lineage(dedup.dedup_keys(articles))
    known = cut_lineage(index.known(key_digests(keys), before=epoch))
    fresh = (keys.join(known.withColumnRenamed("key", "uk"), "uk", "left_anti")
             .join(known.withColumnRenamed("key", "tk"), "tk", "left_anti").select("ord", "uk", "tk"))
    kept = cut_lineage(dedup.greedy_keep(fresh))
    was = ends.latest(before=epoch).first()
    last = was[0] if was is not None and was[0] is not None else -1
    new = articles.join(kept, "ord", "left_semi")
    table.append(U.assign_dense_ids(new.withColumnRenamed("ord", "batch_ord"), "batch_ord", int(last), id_col="ord"), epoch)
    index.add(key_digests(fresh.join(kept, "ord", "left_semi")), epoch)
    ends.write(spark.createDataFrame([(last + kept.count(),)], "last long"), epoch)


def stream_articles(spark: SparkSession, source_dir: str, schema, table: AppendTable, checkpoint: str,
                    once: bool = True, files_per_trigger: int | None = None):
    """R1+R2: landed article files -> article table (``append_new``)."""
    src = spark.readStream.schema(schema)
    if files_per_trigger:
        src = src.option("maxFilesPerTrigger", files_per_trigger)
    w = src.parquet(source_dir).writeStream.foreachBatch(lambda df, epoch: append_new(table, df, epoch))
    return _run(w.option("checkpointLocation", checkpoint), once)


FILES_PER_TRIGGER = 1000


def feed_stream(spark: SparkSession, source_dir: str, files_per_trigger: int = FILES_PER_TRIGGER, glob: str = "*.xml") -> DataFrame:
    """Raw entries (``feeds.feed_entries``) of RSS and Atom files as they land. A file is
    read once, in the micro-batch that it belongs to; a backlog comes ``files_per_trigger``
    files at a time."""
    files = (spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger)
             .option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(source_dir))
    return feeds.feed_entries(files.select(F.col("_metadata.file_path").alias("_file"), "value"))


def stream_xml_articles(spark: SparkSession, source_dir: str, sources: DataFrame, table: AppendTable, checkpoint: str,
                        as_of: datetime, feed_of=None, once: bool = True, files_per_trigger: int = FILES_PER_TRIGGER):
    """R1 for feeds: entries of landed files (``feed_stream``) are normalized and appended like
    ``stream_articles``. ``feed_of`` maps a path column to feed_ord (default: digits at the end
    of the file's name)."""
    feed_of = feed_of or (lambda path: F.regexp_extract(path, r"([0-9]+)\.[a-z]+\z", 1).cast("int"))
    entries = feed_stream(spark, source_dir, files_per_trigger).withColumn("feed_ord", feed_of(F.col("_file"))).drop("_file")

    def batch(df: DataFrame, epoch: int) -> None:
        append_new(table, cut_lineage(normalize.normalize_entries(df, sources, as_of)), epoch)

    return _run(entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), once)


def stream_url_dedup(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """R2, bounded-state form: drop repeats of a URL key seen within the watermark. Rows that
    come later than ``delay`` are not compared; use ``stream_articles`` where none may be lost."""
    return (stream.withColumn("url_key", normalize_url("link"))
            .withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["url_key"]))


def _file_stream(spark: SparkSession, source: str, schema, glob: str | None = None,
                 files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(landed(source, glob))


def landed(source: str, glob: str | None = None) -> str:
    """The path of landed tables: ``glob`` names entries of a folder that are files or folders
    of files (``pathGlobFilter`` would ask for the name of the files inside). In braces it is a
    pattern whatever it holds: a stream takes a plain path for a folder."""
    return f"{source.rstrip('/')}/{{{glob}}}" if glob else source


SUMS = "date string, company_id long, sentiment_sum double, scored long, article_volume long"


def metrics_of(sums: DataFrame) -> DataFrame:
    """The daily metrics that a table of additive sums stands for."""
    return sums.select("date", "company_id", F.when(F.col("scored") > 0, F.col("sentiment_sum") / F.col("scored"))
                       .alias("avg_sentiment"), "article_volume")


SUMS_KEY = ["date", "company_id"]
MENTIONS = "article_id long, company_id long, sentiment_score double, confidence_score double, context_sentence string"
MENTIONS_KEY = ["article_id", "company_id"]


def stream_daily_metrics(spark: SparkSession, source: str, schema, table: MergeTable, checkpoint: str,
                         to_mentions=None, once: bool = True, glob: str | None = None,
                         files_per_trigger: int | None = None):
    """Per (UTC day, company) metrics from a mention stream. A micro-batch is summed per
    day and company and added to the stored sums (``SUMS``) of those days and companies, so a
    file that lands late, however old its days, counts like any other; nothing waits for a
    watermark (``stateful.stream_event_time_metrics`` does)."""
    s = _file_stream(spark, source, schema, glob, files_per_trigger)
    if to_mentions is not None:
        s = to_mentions(s)

    def batch(df: DataFrame, epoch: int) -> None:
        new = (df.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"), "company_id")
               .agg(F.coalesce(F.sum("sentiment_score"), F.lit(0.0)).alias("sentiment_sum"),
                    F.count("sentiment_score").alias("scored"), F.count(F.lit(1)).alias("article_volume")))
        new = cut_lineage(new)
        both = table.lookup(new, before=epoch).unionByName(new)
        table.write(both.groupBy("date", "company_id").agg(*[F.sum(c).alias(c) for c in ("sentiment_sum", "scored", "article_volume")]), epoch)

    return _run(s.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), once)


def stream_mentions(texts: DataFrame, table: MergeTable, checkpoint: str, to_rows, once: bool = True):
    """Texts arriving on a stream are analysed (``to_rows``: texts -> mention rows with
    ``ord``) and their mentions folded and upserted (D7 + U5), micro-batch by micro-batch: only
    the stored rows of the batch's keys are looked up, only what changes is written. An article
    is analysed when it arrives, never again."""
    def batch(df: DataFrame, epoch: int) -> None:
        rows = cut_lineage(to_rows(df))
        table.write(U.upsert_mentions(table.lookup(rows, before=epoch), rows), epoch)

    return _run(texts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), once)


def stream_company_mentions(spark: SparkSession, source_dir: str, schema, table: MergeTable,
                            checkpoint: str, analyze, once: bool = True):
    """R4 over landed article files."""
    return stream_mentions(_file_stream(spark, source_dir, schema), table, checkpoint, analyze, once)


def stream_retention(spark: SparkSession, source_dir: str, schema, table: DayTable, checkpoint: str,
                     days: int, as_of=None, once: bool = True):
    """Each micro-batch adds its articles and applies the retention rule (F7): days that are
    over go as folders, the day of the cutoff is cut when read, nothing is rewritten. ``as_of`` is
    a function that gives the run's "now" (default: the clock), asked at every micro-batch."""
    as_of = as_of or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    src = spark.readStream.schema(schema).parquet(source_dir)

    def batch(df: DataFrame, epoch: int) -> None:
        table.append(df, epoch)
        table.expire(as_of() - timedelta(days=days), epoch)

    return _run(src.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), once)


def daily_metrics_via_stream(spark: SparkSession, landing_dir: str, file_glob: str, to_mentions,
                             files_per_trigger: int | None = None) -> DataFrame:
    """Run R3 over landed event files to completion and return the metrics."""
    root = scratch(spark, "metrics")
    schema = spark.read.parquet(landed(landing_dir, file_glob)).schema
    t = MergeTable(spark, f"{root}/table", SUMS, SUMS_KEY)
    stream_daily_metrics(spark, landing_dir, schema, t, f"{root}/_checkpoint", to_mentions=to_mentions,
                         glob=file_glob, files_per_trigger=files_per_trigger)
    return metrics_of(t.read())


def mentions_via_stream(spark: SparkSession, landing_dir: str, file_glob: str, to_texts, to_rows) -> DataFrame:
    """Run R4 over landed document files to completion and return the mention table."""
    root = scratch(spark, "mentions")
    schema = spark.read.parquet(landed(landing_dir, file_glob)).schema
    t = MergeTable(spark, f"{root}/table", MENTIONS, MENTIONS_KEY)
    stream_mentions(to_texts(_file_stream(spark, landing_dir, schema, file_glob)), t, f"{root}/_checkpoint", to_rows)
    return t.read()


__all__ = ["AppendTable", "DayTable", "MergeTable", "VersionedTable", "append_new", "feed_stream", "stream_articles", "stream_xml_articles", "stream_url_dedup",
           "stream_daily_metrics", "metrics_of", "SUMS", "stream_mentions", "stream_company_mentions",
           "stream_retention", "daily_metrics_via_stream", "mentions_via_stream"]
