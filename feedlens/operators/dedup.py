"""Deduplication: greedy two-key article dedup (D4/D5), mention dedup (D6), fold.

D4 is the lexicographically-first maximal independent set of the "shares a URL key
or a (title, source) key" conflict graph: a row is kept iff no *kept* earlier row
shares a key with it. It is not two ``dropDuplicates``. It runs as rounds of plain
aggregations and joins:

1. among undecided rows, keep the rows that hold the minimum order in both their
   URL-key group and their title-key group (the global minimum always qualifies, so
   every round decides at least one row);
2. drop undecided rows that share either key with a kept row (two anti joins);
3. repeat on what is left; each round's state is checkpointed to the shared folder.

Rounds = the longest chain of alternating key conflicts, two on real data. Only
(order, 16-byte key digests) travel through the rounds; the payload is joined back
once at the end. Group minima are hash aggregates with map-side combine, and the
"is it the minimum" test joins on (key, order) so a hot key does not land in one
task; the anti joins on a hot key are split by AQE's skew handling.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_title, normalize_url
from ..session import cut_lineage


def _digest(c) -> F.Column:
    return F.unhex(F.md5(c))


def dedup_keys(articles: DataFrame, order_col: str = "ord", link: str = "link",
               title: str = "title", source: str = "source") -> DataFrame:
    """(ord, uk, tk): digests of the URL key and of the (title key, lower source) key."""
    tk = F.concat(normalize_title(F.col(title)), F.lit("\u0000"), F.lower(F.col(source)))
    return articles.select(F.col(order_col).alias("ord"),
                           _digest(normalize_url(F.col(link))).alias("uk"),
                           _digest(tk).alias("tk"))


def greedy_keep(keys: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """Orders kept by the greedy two-key scan. ``keys`` has (ord, uk, tk), ord unique."""
    undecided = cut_lineage(keys)
    kept_parts = []
    for _ in range(max_rounds):
        min_u = undecided.groupBy("uk").agg(F.min("ord").alias("ord"))
        min_t = undecided.groupBy("tk").agg(F.min("ord").alias("ord"))
        keep = (undecided.join(min_u, ["uk", "ord"], "left_semi")
                .join(min_t, ["tk", "ord"], "left_semi"))
        keep = cut_lineage(keep)
        kept_parts.append(keep.select("ord"))
        rest = (undecided.join(keep.select("uk"), "uk", "left_anti")
                .join(keep.select("tk"), "tk", "left_anti"))
        undecided = cut_lineage(rest)
        if undecided.isEmpty():
            break
    else:  # pragma: no cover - the global minimum is decided every round
        raise RuntimeError("dedup did not converge")
    return reduce(DataFrame.unionAll, kept_parts)


def dedup_articles(articles: DataFrame, order_col: str = "ord") -> DataFrame:
    """Keep the first article of each URL key and (title key, source) key, greedily."""
    kept = greedy_keep(dedup_keys(articles, order_col))
    return articles.join(kept.withColumnRenamed("ord", order_col), order_col, "left_semi")


def merge_and_dedup(existing: DataFrame, new: DataFrame, order_col: str = "ord") -> DataFrame:
    """Existing rows first, then new rows, then D4. Adds ``batch_ord`` (0/1)."""
    both = (existing.withColumn("batch_ord", F.lit(0))
            .unionByName(new.withColumn("batch_ord", F.lit(1))))
    both = both.withColumn("_mord", F.struct(F.col("batch_ord"), F.col(order_col)))
    kept = greedy_keep(dedup_keys(both, "_mord"))
    return both.join(kept.withColumnRenamed("ord", "_mord"), "_mord", "left_semi").drop("_mord")


def dedup_against(existing: DataFrame, new: DataFrame, order_col: str = "ord") -> DataFrame:
    """D5 for an ``existing`` table that is clean already: the rows of ``new`` that D4 keeps
    after all existing ones. New rows that share a key with an existing row go (the existing
    one comes first and is kept), D4 runs on the others; existing rows are never compared
    among themselves and only their two 16-byte keys are read."""
    keys = dedup_keys(new, order_col)
    have = dedup_keys(existing, order_col)
    fresh = (keys.join(have.select("uk").distinct(), "uk", "left_anti")
             .join(have.select("tk").distinct(), "tk", "left_anti"))
    kept = greedy_keep(fresh.select("ord", "uk", "tk"))
    return new.join(kept.withColumnRenamed("ord", order_col), order_col, "left_semi")


def dedup_mentions(mentions: DataFrame, group: str = "article_id") -> DataFrame:
    """Per (article, ticker, first 100 chars of context) keep the highest
    confidence, earliest start on ties; ``key_pos`` = first sight of the key."""
    ctx100 = F.left(F.col("context_sentence"), F.lit(100))
    cols = [c for c in mentions.columns if c not in (group, "ticker")]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]),
                    F.struct(F.col("confidence"), -F.col("start_char")))
    out = (mentions.withColumn("_ctx100", ctx100)
           .groupBy(group, "ticker", "_ctx100")
           .agg(best.alias("_b"), F.min("start_char").alias("key_pos")))
    return out.select(group, "ticker", *[F.col(f"_b.{c}").alias(c) for c in cols], "key_pos")


def fold_mentions(mentions: DataFrame, bucket_rows: int = 1 << 16) -> DataFrame:
    """Per (article_id, company_id), in arrival order ``ord``, a strictly higher
    confidence replaces the kept row and the new sentiment = (kept + new) / 2.

    Closed form: the rows that replace are the prefix maxima ("records") of the
    confidence sequence; with records r1..rk the result is r_k's row with sentiment
    s1/2^(k-1) + sum_{j>=2} s_j/2^(k-j+1). Rows are cut into ``ord`` buckets, so no window
    sorts a whole group; only each bucket's own running maxima go on (a few per bucket: ln n
    of n rows in random order), and those of a key meet in one window. The windows after the
    first share its partitioning by key.
    """
    key = ["article_id", "company_id"]
    # 1. candidates: the running maxima inside each (key, bucket), found in one bounded window;
    # everything else is dropped before any further step
    m = mentions.withColumn("_b", F.floor(F.col("ord") / bucket_rows))
    wb = Window.partitionBy(*key, "_b").orderBy("ord")
    before = F.max("confidence_score").over(wb.rowsBetween(Window.unboundedPreceding, -1))
    cand = m.withColumn("_prev", before).where(F.col("_prev").isNull() | (F.col("confidence_score") > F.col("_prev"))).drop("_prev")
    # 2. confidences of candidates grow inside a bucket, so the records over all buckets are the
    # candidates above the best of the earlier ones, and one window per key sees them in order
    wk = Window.partitionBy(*key).orderBy("ord")
    best = F.max("confidence_score").over(wk.rowsBetween(Window.unboundedPreceding, -1))
    rec = cand.withColumn("_prev", best).where(F.col("_prev").isNull() | (F.col("confidence_score") > F.col("_prev")))
    rec = rec.withColumn("_n", F.row_number().over(wk))
    payload = [c for c in mentions.columns if c not in key + ["sentiment_score"]]
    last = F.max("_n").over(Window.partitionBy(*key))
    weight = F.pow(F.lit(0.5), F.when(F.col("_n") == 1, F.col("_last_n") - 1).otherwise(F.col("_last_n") - F.col("_n") + 1))
    agg = rec.withColumn("_last_n", last).groupBy(*key).agg(
        F.sum(F.col("sentiment_score") * weight).alias("sentiment_score"),
        F.max_by(F.struct(*[F.col(c) for c in payload]), F.col("ord")).alias("_last"),
        F.count(F.lit(1)).alias("replacements"))
    return agg.select(*key, "sentiment_score", *[F.col(f"_last.{c}").alias(c) for c in payload],
                      (F.col("replacements") - 1).alias("replacements"))
