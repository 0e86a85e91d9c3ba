import itertools
import random

from pyspark.sql import functions as F

from conftest import make_articles, rows
from feedlens.functions import text as X
from feedlens.operators import dedup


def test_url_key_lower_and_trailing_slash(spark):
    df = spark.createDataFrame([(" HTTPS://Ex.com/A/Story// ",), ("https://ex.com/a/story/?a=1",),
                                ("https://ex.com/a#frag?x",)], "u string")
    got = [r[0] for r in df.select(X.normalize_url("u")).collect()]
    # the trailing slash is removed before the query is cut, so '/story/?a=1' keeps its slash
    assert got == ["https://ex.com/a/story", "https://ex.com/a/story/", "https://ex.com/a"]


def test_title_key_collapses_whitespace(spark):
    df = spark.createDataFrame([("  Big\t\nNews  Today \x1f",)], "t string")
    assert df.select(X.normalize_title("t")).first()[0] == "big news today"


def test_fingerprint_is_md5_of_url_key(spark):
    import hashlib
    df = spark.createDataFrame([("https://Ex.com/x/?q=1",)], "u string")
    assert df.select(X.fingerprint("u")).first()[0] == hashlib.md5(b"https://ex.com/x/").hexdigest()


def check_greedy(items, kept):
    """The greedy choice is the one set of rows without a shared key in which every row left
    out shares a key with an earlier row of the set. items: (order, title, url, source)."""
    def keys(item):
        _, title, url, source = item
        return {("url", url.lower().rstrip("/")), ("title", " ".join(title.lower().split()), source.lower())}
    taken = {}
    for item in items:
        if item[0] in kept:
            assert not keys(item) & taken.keys()
            taken |= dict.fromkeys(keys(item), item[0])
        else:
            assert any(taken.get(k) in kept for k in keys(item)), item
    assert set(kept) <= {i[0] for i in items}


def test_exact_url_duplicate_first_wins(spark):
    a = make_articles(spark, [(1, "A", "https://x.com/1", "S"), (2, "B", "https://X.com/1/", "S")])
    assert sorted(r[0] for r in rows(dedup.dedup_articles(a), "ord")) == [1]


def test_same_title_same_source_dropped_other_source_kept(spark):
    a = make_articles(spark, [(1, "Same  Title", "https://x.com/1", "Src"), (2, "same title", "https://x.com/2", "SRC"),
                              (3, "Same Title", "https://x.com/3", "Other")])
    assert sorted(r[0] for r in rows(dedup.dedup_articles(a), "ord")) == [1, 3]


def test_greedy_not_two_passes(spark):
    # (u1,t1), (u2,t1), (u2,t2): row 2 is dropped by row 1, so row 3 survives
    a = make_articles(spark, [(1, "t1", "https://u/1", "s"), (2, "t1", "https://u/2", "s"),
                              (3, "t2", "https://u/2", "s")])
    assert sorted(r[0] for r in rows(dedup.dedup_articles(a), "ord")) == [1, 3]


def test_empty_input(spark):
    a = make_articles(spark, [])
    assert dedup.dedup_articles(a).count() == 0


def test_greedy_matches_sequential_scan_on_random_chains(spark):
    rnd = random.Random(7)
    items = [(i, f"t{rnd.randint(0, 12)}", f"https://u/{rnd.randint(0, 12)}", rnd.choice(["a", "b"]))
             for i in range(120)]
    a = make_articles(spark, items)
    check_greedy(items, [r[0] for r in rows(dedup.dedup_articles(a), "ord")])


def test_merge_keeps_existing_first(spark):
    old = make_articles(spark, [(5, "Old", "https://x.com/a", "S")])
    new = make_articles(spark, [(1, "New", "https://x.com/a", "S"), (2, "Other", "https://x.com/b", "S")])
    out = dedup.merge_and_dedup(old, new)
    assert sorted(rows(out, "batch_ord", "ord")) == [(0, 5), (1, 2)]


def test_mention_dedup_highest_confidence_first_on_ties(spark):
    df = spark.createDataFrame([
        (1, "NVDA", 10, 0.9, "ctx one"), (1, "NVDA", 30, 0.9, "ctx one"), (1, "NVDA", 50, 0.95, "ctx one"),
        (1, "NVDA", 70, 0.8, "other ctx"), (1, "MSFT", 5, 0.9, "ctx one")],
        "article_id long, ticker string, start_char long, confidence double, context_sentence string")
    out = sorted(rows(dedup.dedup_mentions(df), "ticker", "start_char", "key_pos"))
    assert out == [("MSFT", 5, 5), ("NVDA", 50, 10), ("NVDA", 70, 70)]


MENTION = "ord long, article_id long, company_id long, sentiment_score double, confidence_score double, context_sentence string"


def test_fold_of_one_pair(spark):
    # 0.5 replaces 0.1: (1 + 0) / 2; 0.3 and the equal 0.5 don't count; 0.9 replaces: (0.5 + 0.7) / 2
    rows_ = [(0, 1, 1, 1.0, 0.1, "a"), (1, 1, 1, 0.0, 0.5, "b"), (2, 1, 1, 9.0, 0.3, "c"), (3, 1, 1, 9.0, 0.5, "d"),
             (4, 1, 1, 0.7, 0.9, "e"), (5, 1, 2, -0.2, 0.4, "f")]
    df = spark.createDataFrame(rows_, MENTION)
    for bucket in (1, 2, 1 << 16):
        got = {r.company_id: r for r in dedup.fold_mentions(df, bucket_rows=bucket).collect()}
        assert abs(got[1].sentiment_score - 0.6) < 1e-12 and got[1].context_sentence == "e" and got[1].replacements == 2
        assert (got[2].sentiment_score, got[2].context_sentence, got[2].replacements) == (-0.2, "f", 0)


def test_fold_does_not_depend_on_buckets(spark):
    rnd = random.Random(3)
    ms = [(i, rnd.randint(0, 3), 1 + rnd.randint(0, 1), rnd.uniform(-1, 1), round(rnd.uniform(0, 1), 2), f"c{i}") for i in range(300)]
    df = spark.createDataFrame(ms, MENTION)
    by_size = [{(r.article_id, r.company_id): r for r in dedup.fold_mentions(df, bucket_rows=n).collect()} for n in (1, 7, 1 << 16)]
    for key, r in by_size[0].items():
        own = [m for m in ms if (m[1], m[2]) == key]
        best = max(m[4] for m in own)
        peaks = list(itertools.accumulate((m[4] for m in own), max))
        assert r.confidence_score == best and r.context_sentence == next(m[5] for m in own if m[4] == best)
        assert r.replacements == len(set(peaks)) - 1
        assert all(abs(other[key].sentiment_score - r.sentiment_score) < 1e-12 for other in by_size)
    assert len(by_size[0]) == len({(m[1], m[2]) for m in ms})


def test_dedup_uses_shared_checkpoint_dir(spark):
    from feedlens.session import checkpoint_dir
    assert checkpoint_dir(spark)
    assert F is not None


def test_merge_is_greedy_with_existing_rows_first(spark):
    rnd = random.Random(13)
    made = lambda n, tail: [(i, f"t{rnd.randint(0, 9)}", f"https://u/{rnd.randint(0, 9)}{tail}", rnd.choice(["a", "B"])) for i in range(n)]
    first, new = made(40, ""), made(60, "/")
    clean = [r[0] for r in rows(dedup.dedup_articles(make_articles(spark, first)), "ord")]
    old = [x for x in first if x[0] in clean]
    every = [(x[0] - 1000, *x[1:]) for x in old] + new
    out = dedup.merge_and_dedup(make_articles(spark, old), make_articles(spark, new)).collect()
    check_greedy(every, [r.ord - 1000 if r.batch_ord == 0 else r.ord for r in out])
    added = dedup.dedup_against(make_articles(spark, old), make_articles(spark, new)).collect()
    assert sorted(r.ord for r in added) == sorted(r.ord for r in out if r.batch_ord == 1)
