"""Merge-on-read tables, the key index and the day table: exact, and no dearer than the batch."""
import random
import uuid
from datetime import datetime

import pyarrow as pa
from pyspark.sql import functions as F

from feedlens.session import checkpoint_dir
from feedlens.sources import keyindex
from feedlens.sources.merge import MergeTable
from feedlens.sources.sinks import DayTable


def _root(spark):
    return f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex[:8]}"


SCHEMA = "a long, b string, x double"


def test_merge_table_equals_a_dict(spark):
    """Random upserts, removals, repeated versions and folds; null keys too."""
    rng = random.Random(4)
    t = MergeTable(spark, f"{_root(spark)}/t", SCHEMA, ["a", "b"], buckets=4, compact_after=3)
    want: dict = {}
    for v in range(8):
        rows = {(rng.choice([1, 2, 3, None]), rng.choice(["p", "q", None])): rng.random() for _ in range(5)}
        gone = [k for k in want if rng.random() < 0.2]
        if v == 5:      # a first attempt at this batch that wrote something else
            t.write(spark.createDataFrame([(9, "bad", 1.0)], SCHEMA), v)
        before = dict(want)
        t.write(spark.createDataFrame([(*k, x) for k, x in rows.items()], SCHEMA), v, gone=spark.createDataFrame(gone, "a long, b string"))
        want = {k: x for k, x in want.items() if k not in gone} | rows
        assert {(r.a, r.b): r.x for r in t.read().collect()} == want
        assert {(r.a, r.b): r.x for r in t.read(before=v).collect()} == before
        asked = [(1, "p"), (None, "q"), (7, "nowhere")]
        got = {(r.a, r.b): r.x for r in t.lookup(spark.createDataFrame(asked, "a long, b string")).collect()}
        assert got == {k: want[k] for k in asked if k in want}


def test_a_fold_rewrites_the_touched_buckets_only(spark):
    root = _root(spark)
    t = MergeTable(spark, f"{root}/t", "k long, v string", ["k"], buckets=16)
    t.write(spark.range(1000).selectExpr("id AS k", "'old' AS v"), 0)
    assert t.compact(0) == list(range(16))
    t.write(spark.createDataFrame([(3, "new")], "k long, v string"), 1)
    delta = spark.read.parquet(f"{root}/t/delta/v=1")
    assert delta.count() == 1                       # a write costs its rows
    touched = t.compact(1)
    assert len(touched) == 1
    files = spark.read.parquet(f"{root}/t/base/g=1")
    assert 0 < files.count() < 200 and t.read().count() == 1000
    assert t.read().where("v = 'new'").count() == 1
    own = t._map()
    assert sorted(b for b, g in own.items() if g == 1) == touched and len(own) == 16
    t.write(spark.createDataFrame([], "k long, v string"), 2, gone=t.read().select("k"))
    t.compact(2)
    assert t.read().count() == 0 and t._map() == {}


def digests(spark, names):
    return spark.createDataFrame([(n,) for n in names], "n string").select(F.unhex(F.md5("n")).alias("key"))


def test_lookups_read_what_the_batch_repeats(spark):
    index = keyindex.KeyIndex(spark, f"{_root(spark)}/k", buckets=4)
    assert index.known(digests(spark, ["a"])).count() == 0
    for v in range(6):
        index.add(digests(spark, [f"{v}-{i}" for i in range(400)]).unionByName(digests(spark, [None])), v)
    new = digests(spark, [f"new-{i}" for i in range(50)])
    assert len(index.candidates(new)) <= 3          # 24 segments of 100 keys; false positives only
    some = digests(spark, ["2-7", "2-8", "5-1", "nowhere", None])
    pairs = index.candidates(some)
    assert index.segments(pairs).count() <= 150 * 6  # whatever the table holds
    assert {bytes(r[0]).hex() for r in index.known(some).collect()} == {bytes(r[0]).hex() for r in digests(spark, ["2-7", "2-8", "5-1"]).collect()}
    assert index.known(digests(spark, ["5-1", "2-7"]), before=5).count() == 1
    index.add(digests(spark, ["again"]), 5)         # a retried batch overwrites its segments
    assert index.known(digests(spark, ["5-1", "again"])).count() == 1


def test_false_positives_cost_reading_only(spark):
    index = keyindex.KeyIndex(spark, f"{_root(spark)}/k", buckets=2, bits=1)
    index.add(digests(spark, [f"k{i}" for i in range(300)]), 0)
    asked = digests(spark, [f"other{i}" for i in range(300)])
    assert len(index.candidates(asked)) == 2        # filters this small exclude nothing
    assert index.known(asked).count() == 0 and index.known(digests(spark, ["k1", "z"])).count() == 1


def test_filters_hold_all_their_keys():
    rng = random.Random(1)
    keys = [rng.randbytes(16) for _ in range(3000)]
    f = keyindex.make_filter(pa.array(keys, pa.binary()))
    assert keyindex.may_hold(f, pa.array(keys, pa.binary())).all()
    others = [rng.randbytes(16) for _ in range(20_000)]
    assert keyindex.may_hold(f, pa.array(others, pa.binary())).mean() < 0.002


def test_day_table_drops_days_and_cuts_one(spark):
    root = _root(spark)
    t = DayTable(spark, f"{root}/t", "k long, published_at timestamp")
    days = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 1, 3, 5)), (3, datetime(2024, 1, 3, 18)), (4, None), (5, datetime(2024, 1, 4))]
    t.append(spark.createDataFrame(days, t.schema), 0)
    assert sorted(r.k for r in t.read().collect()) == [1, 2, 3, 4, 5]
    t.expire(datetime(2024, 1, 3, 12), 0)
    assert sorted(r.k for r in t.read().collect()) == [3, 4, 5]
    t.append(spark.createDataFrame([(6, datetime(2024, 1, 2)), (7, datetime(2024, 1, 9))], t.schema), 1)
    t.expire(datetime(2024, 1, 4), 1)
    assert sorted(r.k for r in t.read().collect()) == [4, 5, 7]
    left = spark.read.option("basePath", f"{root}/t").parquet(f"{root}/t/v=0", f"{root}/t/v=1")
    assert sorted(str(r[0]) for r in left.select("_day").distinct().collect()) == ["2024-01-04", "2024-01-09", "None"]
