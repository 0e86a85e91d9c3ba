"""Event-time state (R2, R3): processors whose state lives in Spark's state store, per key,
and goes when the watermark passes.

* ``day_sums``: per (UTC day, company) sums of a mention stream. Open days lie in the state
  store; a day closes when the watermark reaches its end. Rows of closed days (late ones) are
  counted aside, so nothing is lost whatever the order of the files: closed or open sums and
  late ones add up to what a batch over all rows gives.
* ``first_per_key``: drops repeats of a URL key until the kept row's time is ``expiry`` behind,
  then the key comes again.

Both need Spark's RocksDB state store, which ``start`` sets for the query it starts. Rows
are reduced before the shuffle where that is possible (``partial_sums``), and a hot day or key
sends its state, not its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import normalize_url
from ..sources.merge import MergeTable

DAY_MS = 24 * 3600 * 1000
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession):
    """The state store of queries started inside (a query keeps the settings it starts with)."""
    name, value = PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def start(writer, spark: SparkSession, once: bool = True):
    with rocksdb(spark):
        q = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 minutes")).start()
    if once:
        q.awaitTermination()
    return q


# ------------------------------------------------------------------------- daily sums

PARTIAL = "date string, company_id long, day_end long, sentiment_sum double, scored long, article_volume long"
SUMS_OUT = "date string, company_id long, late boolean, sentiment_sum double, scored long, article_volume long"
TABLE = "date string, company_id long, part long, sentiment_sum double, scored long, article_volume long"
TABLE_KEY = ["date", "company_id", "part"]
OPEN = -1          # ``part`` of a day's own sums; late ones have their batch's number


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows of one Arrow batch: what a combiner does before the shuffle."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["date", "company_id", "day_end"]).aggregate(
            [("sentiment_score", "sum"), ("sentiment_score", "count"), ("one", "sum")])
        yield from t.rename_columns(["date", "company_id", "day_end", "sentiment_sum", "scored", "article_volume"]).to_batches()


class DaySums(StatefulProcessor):
    """Adds up a day's partial sums. ``closing``: give a day's sums once, when it closes (append
    mode); else the sums so far whenever they change (update mode). Late rows come at once."""

    def __init__(self, closing: bool):
        self.closing = closing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "sentiment_sum double, scored long, article_volume long")

    def _row(self, key, late: bool, sums) -> Row:
        return Row(date=key[0], company_id=key[1], late=late, sentiment_sum=sums[0], scored=sums[1], article_volume=sums[2])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        total, scored, volume = 0.0, 0, 0
        for r in rows:
            total, scored, volume = total + (r.sentiment_sum or 0.0), scored + r.scored, volume + r.article_volume
        if key[2] <= timerValues.getCurrentWatermarkInMs():
            yield self._row(key, True, (total, scored, volume))
            return
        old = self.sums.get() if self.sums.exists() else None
        if old is None:
            self.handle.registerTimer(key[2])
            old = (0.0, 0, 0)
        now = (old[0] + total, old[1] + scored, old[2] + volume)
        self.sums.update(now)
        if not self.closing:
            yield self._row(key, False, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if self.closing:
            yield self._row(key, False, self.sums.get())
        self.sums.clear()

    def close(self) -> None:
        pass


def day_sums(mentions: DataFrame, delay: str, mode: str = "update") -> DataFrame:
    """``SUMS_OUT`` of a mention stream with the watermark ``delay`` behind the newest
    ``created_at``. Rows without a time are late ones of no date. ``day_end`` is a number, not
    the event-time column, so Spark hands late rows on instead of dropping them."""
    if mode not in ("update", "append"):
        raise ValueError("mode must be update or append")
    end = F.unix_millis(F.window("at", "1 day")["end"])
    timed = mentions.withWatermark("created_at", delay)
    day = timed.withColumn("at", F.coalesce(F.col("created_at"), F.timestamp_seconds(F.lit(0)))).select(
        F.date_format("created_at", "yyyy-MM-dd").alias("date"), "company_id",
        F.when(F.col("created_at").isNull(), 0).otherwise(end).cast("long").alias("day_end"),
        "sentiment_score", F.lit(1).cast("long").alias("one"))
    return (day.mapInArrow(partial_sums, PARTIAL).groupBy("date", "company_id", "day_end")
            .transformWithState(DaySums(mode == "append"), SUMS_OUT, mode.capitalize(), "EventTime"))


def daily_sums_table(spark: SparkSession, path: str, **options) -> MergeTable:
    return MergeTable(spark, path, TABLE, TABLE_KEY, **options)


def stream_event_time_metrics(mentions: DataFrame, table: MergeTable, checkpoint: str, delay: str,
                              mode: str = "update", once: bool = True):
    """R3 with event-time state: a micro-batch writes the sums that it changes, and its late
    rows aside, to ``table`` (``TABLE``); a retried one overwrites what it wrote."""
    def batch(df: DataFrame, epoch: int) -> None:
        part = F.when(F.col("late"), F.lit(epoch)).otherwise(F.lit(OPEN)).cast("long")
        table.write(df.withColumn("part", part), epoch)

    spark = mentions.sparkSession
    w = day_sums(mentions, delay, mode).writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", checkpoint)
    return start(w, spark, once)


def event_time_metrics(table: MergeTable) -> DataFrame:
    """date, company_id, avg_sentiment, article_volume, late_volume: days with their late rows."""
    sums = [F.sum(c).alias(c) for c in ("sentiment_sum", "scored", "article_volume")]
    late = F.coalesce(F.sum(F.when(F.col("part") != OPEN, F.col("article_volume"))), F.lit(0)).alias("late_volume")
    return table.read().groupBy("date", "company_id").agg(*sums, late).select(
        "date", "company_id", F.when(F.col("scored") > 0, F.col("sentiment_sum") / F.col("scored")).alias("avg_sentiment"),
        "article_volume", "late_volume")


# ------------------------------------------------------------------------- URL keys (R2)

class FirstPerKey(StatefulProcessor):
    """Keeps a row unless its key was kept less than ``expiry_ms`` before it (event time),
    in the order of batches and, inside one, of ``ord``. ``unchecked`` marks rows so late that
    what they would repeat has been forgotten; they are kept."""

    def __init__(self, expiry_ms: int):
        self.expiry_ms = expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "at long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        was = self.kept.get()[0] if self.kept.exists() else None
        last, now = was, timerValues.getCurrentWatermarkInMs()
        for r in sorted(rows, key=lambda r: r.ord):     # the key's rows of one micro-batch
            if last is None or r.at_ms >= last + self.expiry_ms:
                unchecked = last is None and r.at_ms + self.expiry_ms <= now
                yield Row(**{**r.asDict(), "unchecked": unchecked})
                if not unchecked:
                    last = r.at_ms
        if last != was:
            if was is not None:
                self.handle.deleteTimer(was + self.expiry_ms)
            self.handle.registerTimer(last + self.expiry_ms)
            self.kept.update((last,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_per_key(articles: DataFrame, expiry_seconds: int, delay: str) -> DataFrame:
    """R2, bounded state: the rows of an article stream that are the first of their URL key, or
    whose key was last kept ``expiry_seconds`` before them; column ``unchecked``. A key's state
    goes once the watermark (``delay`` behind the newest ``published_at``) has passed its
    expiry. Rows without a time can't expire and are taken at the epoch's start."""
    at = F.coalesce(F.unix_millis("published_at"), F.lit(0).cast("long"))
    keyed = (articles.withWatermark("published_at", delay).withColumn("at_ms", at)
             .withColumn("url_key", F.coalesce(normalize_url("link"), F.lit(""))))
    # the time travels as a number, so Spark hands late rows on; nullable columns come as they are
    out = StructType([f for f in keyed.schema.fields if f.name != "published_at"]).add("unchecked", "boolean")
    done = (keyed.drop("published_at").groupBy("url_key")
            .transformWithState(FirstPerKey(expiry_seconds * 1000), out, "Append", "EventTime"))
    return done.withColumn("published_at", F.when(F.col("at_ms") != 0, F.timestamp_millis("at_ms"))).drop("at_ms", "url_key")
