"""Event-time state: sums per day with late rows aside, URL keys that expire."""
import random
import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedlens.operators import metrics
from feedlens.session import checkpoint_dir
from feedlens.streaming import stateful as SF
from feedlens.streaming.ingest import AppendTable

MENTIONS = "ord long, company_id long, sentiment_score double, created_at timestamp"


def _root(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex[:8]}"


def run(spark, root, table, n, rows, mode="update", schema=MENTIONS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{root}/in/{n}")
    s = spark.readStream.schema(schema).parquet(f"{root}/in/*")
    return SF.stream_event_time_metrics(s, table, f"{root}/ck", "12 hours", mode)


def key(df):
    return sorted(((r.date or "", r.company_id, None if r.avg_sentiment is None else round(r.avg_sentiment, 9), r.article_volume)
                   for r in df.collect()), key=str)


def day(d, h=0):
    return datetime(2024, 1, d, h)


def test_out_of_order_landings_add_up_and_state_stays_small(spark):
    """Each landing is a run of its own, so every one restarts from the checkpoint."""
    rng = random.Random(2)
    root = _root(spark)
    t = SF.daily_sums_table(spark, f"{root}/t", compact_after=2)
    every, held = [], []
    for n, days in enumerate([(5, 9), (1, 6), (8, 14), (2, 3), (13, 20)]):
        rows = [(len(every) + i, rng.randrange(1, 4), rng.choice([None, rng.uniform(-1, 1)]), day(rng.randrange(*days), rng.randrange(24)))
                for i in range(120)]
        rows.append((10_000 + n, 1, 0.5, None))
        every += rows
        q = run(spark, root, t, n, rows)
        held.append(max(p.stateOperators[0].numRowsTotal for p in q.recentProgress[-1:]))
        assert sum(s.numRowsDroppedByWatermark for p in q.recentProgress for s in p.stateOperators) == 0
    got = SF.event_time_metrics(t)
    assert key(got) == key(metrics.daily_metrics(spark.createDataFrame(every, MENTIONS)))
    late = {r.date: r.late_volume for r in got.where("company_id = 1").collect()}
    assert late["2024-01-02"] > 0 and late["2024-01-19"] == 0 and late[None] == 5
    assert max(held) <= 3 * 8         # days behind the watermark have left the store
    parts = spark.read.option("basePath", f"{root}/t/delta").parquet(*[f"{root}/t/delta/v={v}" for v in t.deltas._versions()[-1:]])
    assert parts.count() <= 3 * 8     # a micro-batch writes what it touched


def test_append_mode_gives_closed_days_once(spark):
    root = _root(spark)
    t = SF.daily_sums_table(spark, f"{root}/t")
    run(spark, root, t, 0, [(1, 1, 0.5, day(1, 3)), (2, 1, 0.1, day(2, 1))], "append")
    assert t.read().count() == 0 or {r.date for r in t.read().collect()} == {"2024-01-01"}
    run(spark, root, t, 1, [(3, 1, 0.9, day(4))], "append")
    assert {(r.date, r.part, r.article_volume) for r in t.read().collect()} == {("2024-01-01", -1, 1), ("2024-01-02", -1, 1)}
    run(spark, root, t, 2, [(4, 1, 0.7, day(1)), (5, 2, 0.7, day(4))], "append")
    got = {(r.date, r.article_volume, r.late_volume) for r in SF.event_time_metrics(t).collect()}
    assert got == {("2024-01-01", 2, 1), ("2024-01-02", 1, 0)}


ARTS = "ord long, link string, published_at timestamp"


def expiring(batches, hours):
    """The rule written out: batch by batch, in the order of ord."""
    last, kept = {}, []
    for rows in batches:
        for ord_, link, at in sorted(rows):
            if link not in last or at >= last[link] + timedelta(hours=hours):
                last[link] = at
                kept.append(ord_)
    return sorted(kept)


def test_keys_come_again_after_their_expiry(spark):
    rng = random.Random(9)
    root = _root(spark)
    batches = [[(1000 * n + i, f"https://x/{rng.randrange(12)}", day(1) + timedelta(hours=rng.randrange(100))) for i in range(80)] for n in range(3)]
    t = AppendTable(spark, f"{root}/t", "ord long, unchecked boolean")
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ARTS).repartition(3).write.parquet(f"{root}/in/{n}")
        s = SF.first_per_key(spark.readStream.schema(ARTS).parquet(f"{root}/in/*"), 24 * 3600, "30 days")
        SF.start(s.writeStream.outputMode("append").foreachBatch(lambda df, e: t.append(df, e)).option("checkpointLocation", f"{root}/ck"), spark)
    assert sorted(r.ord for r in t.read().where("NOT unchecked").collect()) == expiring(batches, 24)
    assert t.read().where("unchecked").count() == 0


def test_forgotten_keys_are_marked(spark):
    """A row that comes after its key's state has gone is kept and says so; state is bounded."""
    root = _root(spark)
    t = AppendTable(spark, f"{root}/t", "ord long, unchecked boolean, published_at timestamp")
    batches = [[(1, "https://x/a", day(1)), (2, "https://x/b", day(9))], [(3, "https://x/a", day(1, 5)), (4, "https://x/b", day(9, 5)), (5, "https://x/c", None)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ARTS).write.parquet(f"{root}/in/{n}")
        s = SF.first_per_key(spark.readStream.schema(ARTS).parquet(f"{root}/in/*"), 24 * 3600, "1 hour")
        q = SF.start(s.writeStream.outputMode("append").foreachBatch(lambda df, e: t.append(df, e)).option("checkpointLocation", f"{root}/ck"), spark)
    got = {r.ord: (r.unchecked, r.published_at) for r in t.read().collect()}
    assert got == {1: (False, day(1)), 2: (False, day(9)), 3: (True, day(1, 5)), 5: (True, None)}
    assert q.recentProgress[-1].stateOperators[0].numRowsTotal <= 3      # b and its timer
    assert F is not None
