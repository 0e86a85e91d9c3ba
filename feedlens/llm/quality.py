"""Quality rules with risk-controlled cutoffs.

Six rules measure a document from 0 to 1000 (larger is worse): symbols, repeated windows,
repeated lines, capitals, punctuation, word length. Labelled documents (``quality`` 1 good, 0
bad) are split by a hash of doc_id into a selection half and a holdout half. Per stratum (lang):

1. On the selection half each rule proposes a cutoff: the one that gains most (bad documents
   rejected, less ``GOOD_COST`` times the good ones), put midway into the gap below it. Rules
   are ordered by their gain; one that gains less than ``MIN_GAIN`` on the documents that
   those before it leave stays off, so no rule rejects for what others find already.
2. The proposals form one path of ever stricter rule sets: the first rule's cutoff falls from
   1000 to its proposal, then the second's, and so on. Each document has the step at which it
   is first rejected, so rule sets along the path are nested.
3. On the holdout half the path is walked from lenient to strict while the exact binomial test
   of "more than ``ALPHA`` of the good documents are rejected" rejects at ``DELTA`` divided by
   the strata tested (Bonferroni). Walking a fixed path and stopping at the first step that
   isn't certified needs no correction along the path, so with probability 1 - ``DELTA`` no
   stratum loses over ``ALPHA`` of its good documents to the rules, all rules together.

A stratum without enough labels to certify a step rejects nothing beyond the base rule.
Everything is counted over all labelled documents by Spark; cutoffs are a table with one row
per stratum that a join brings to the documents.

Null text has no words. Null lang is a stratum of its own. Rows that share a doc_id count and
are judged each on their own; a doc_id labelled twice is good if one label is. Null doc_ids and
null qualities count as unlabelled. Very long texts are measured whole, a document at a time.
Empty tables give no rows, and no labels no cutoffs. Columns other than doc_id, text, lang and
the labels are never read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, texts_of

ALPHA = 0.05       # share of good documents that a stratum may lose
DELTA = 0.05       # probability that some stratum loses more
GOOD_COST = 10     # a rejected good document outweighs so many rejected bad ones
MIN_GAIN = 3
BROADCAST_ROWS = 10_000
BASE_WORDS = 10
BASE_REPEATS = 20  # percent

RULES = ["symbols", "repeats", "lines", "capitals", "punctuation", "length"]
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
WINDOW = 5

STATS = ("doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
         "n_repeat_words long, " + ", ".join(f"{r} int" for r in RULES))


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more in the list."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    code, size = ids, len(seen)
    for k in range(1, WINDOW):
        if size * len(seen) >= 2 ** 62:     # codes stay exact: number those that occur
            code = np.unique(code, return_inverse=True)[1]
            size = int(code.max()) + 1
        code, size = code[:-1] * len(seen) + ids[k:], size * len(seen)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[WINDOW:] -= twice
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The columns of ``STATS`` after lang, for one text."""
    words = text.split()
    n = len(words)
    points = len(text) - sum(text.count(bytes([c])) for c in SPACE) if text.isascii() else len(text.decode().translate(
        dict.fromkeys(SPACE)))
    symbols = _count(text, SYMBOLS)
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    letters, capitals, punctuation = _count(text, LETTERS), _count(text, CAPITALS), _count(text, PUNCTUATION)
    return (n, points, symbols, dup, repeats,
            min(1000, 1000 * symbols // max(points, 1)), 1000 * repeats // max(n, 1), 1000 * dup // max(lines, 1),
            1000 * capitals // max(letters, 1), min(1000, 1000 * punctuation // max(points, 1)), min(1000, 10 * points // max(n, 1)))


def statistics(docs: DataFrame) -> DataFrame:
    """``STATS`` of every row, over the whole text."""
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        made = list(zip(*map(measure, texts_of(b))))
        kinds = [pa.int64()] * 5 + [pa.int32()] * len(RULES)
        return pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(made, kinds))],
            names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text"), rows, STATS)


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, good, holdout and the rules' values of the labelled documents. ``stratum`` is
    lang behind an ``s``, null an empty string."""
    known = cut_lineage(labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
                        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") > 0).alias("good")))
    half = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) >= "8"
    return stats.join(known, "doc_id").select(stratum_of().alias("stratum"), "good", half.alias("holdout"), *RULES)


def small(per_stratum: DataFrame) -> DataFrame:
    """A checkpointed table of one row per stratum, to be broadcast if it is small enough."""
    return F.broadcast(per_stratum) if per_stratum.count() <= BROADCAST_ROWS else per_stratum


def stratum_of():
    return F.coalesce(F.concat(F.lit("s"), F.col("lang")), F.lit(""))


def proposals(known: DataFrame) -> DataFrame:
    """stratum, rule (its number), cutoff, place (its order), start (step before the rule's
    first): the path of each stratum, from the selection half. Values are at most 1001 per
    rule, so the windows are small whatever the rows."""
    sel = known.where("NOT holdout").withColumn("worth", F.when(F.col("good"), -GOOD_COST).otherwise(1))
    at = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(r).alias("value")) for k, r in enumerate(RULES)]))
    seen = sel.select("stratum", "worth", at.alias("x")).groupBy("stratum", "x.rule", "x.value").agg(F.sum("worth").alias("worth"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("value"))
    # cutting just below a value that occurs rejects it and all above; the next value down stays
    cuts = seen.select("stratum", "rule", "value", F.sum("worth").over(down).alias("gain"),
                       F.coalesce(F.lead("value").over(down), F.lit(0)).alias("below"))
    best = Window.partitionBy("stratum", "rule").orderBy(F.desc("gain"), F.desc("value"))
    top = (cuts.where(F.col("gain") >= MIN_GAIN).where("value > 0").withColumn("k", F.row_number().over(best)).where("k = 1")
           .select("stratum", "rule", "gain", F.floor((F.col("value") - 1 + F.col("below")) / 2).cast("int").alias("cutoff")))
    order = Window.partitionBy("stratum").orderBy(F.desc("gain"), "rule")
    top = cut_lineage(top.withColumn("place", F.row_number().over(order)).drop("gain"))
    # what each rule rejects first, of its order: those that add too little go
    first = F.least(*[F.when(F.col(r) > F.col(f"c{k}"), F.col(f"p{k}")) for k, r in enumerate(RULES)])
    adds = (sel.join(small(cut_lineage(by_rule(top, c="cutoff", p="place"))), "stratum").groupBy("stratum", first.alias("place"))
            .agg(F.sum("worth").alias("adds")).where(F.col("adds") >= MIN_GAIN).drop("adds"))
    path = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return top.join(adds, ["stratum", "place"]).withColumn("start", F.coalesce(F.sum(1000 - F.col("cutoff")).over(path), F.lit(0)))


def by_rule(proposed: DataFrame, steps: bool = False, **columns: str) -> DataFrame:
    """One row per stratum: each of ``columns`` (prefix -> column) of each rule, null: off."""
    cols = [F.max(F.when(F.col("rule") == k, F.col(c))).alias(f"{name}{k}") for k in range(len(RULES)) for name, c in columns.items()]
    return proposed.groupBy("stratum").agg(*cols, *[F.sum(1000 - F.col("cutoff")).alias("steps")] * steps)


def paths(proposed: DataFrame) -> DataFrame:
    """One row per stratum: c0.., s0.. (cutoff and start of each rule, null: off) and steps."""
    return by_rule(proposed, steps=True, c="cutoff", s="start")


def step_of():
    """The step of its stratum's path at which a document is first rejected (null: never)."""
    each = [F.when(F.col(r) > F.col(f"c{k}"), F.col(f"s{k}") + 1001 - F.col(r)) for k, r in enumerate(RULES)]
    return F.least(*each)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n), each with probability p: the exact test's level. Sums the side that
    k lies on from its largest term outwards, so its work doesn't follow n."""
    if k >= n:
        return 1.0
    low = k <= n * p
    i = k if low else k + 1
    term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    total = 0.0
    while term > total * 1e-17 and 0 <= i <= n:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p if low else (n - i) / (i + 1) * p / (1 - p)
        i += -1 if low else 1
    return min(1.0, total) if low else max(0.0, 1.0 - total)


def allowed(n: int, alpha: float, level: float) -> int:
    """The most rejected good documents, of n, with which the test still certifies; -1: none."""
    if n == 0 or binomial_tail(0, n, alpha) > level:
        return -1
    lo, hi = 0, max(1, int(n * alpha) + 1)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if binomial_tail(mid, n, alpha) <= level else (lo, mid)
    return lo


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact (Clopper-Pearson) upper bound of a share seen k times in n, by bisection."""
    if k >= n:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > level else (lo, mid)
    return hi


def certified(known: DataFrame, by_stratum: DataFrame) -> DataFrame:
    """stratum, the columns of ``paths``, n (good holdout documents), bar (how many of them
    the certified step may reject, at most), strata, step (certified; 0: none), rejected."""
    good = known.where("holdout AND good").join(small(by_stratum), "stratum").select("stratum", step_of().alias("step"))
    counts = good.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    strata = by_stratum.count()
    bar = F.udf(lambda n: allowed(n, ALPHA, DELTA / strata), "long")      # once per stratum
    base = (by_stratum.join(sizes, "stratum", "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("strata", F.lit(strata)).withColumn("bar", bar("n")))
    up = Window.partitionBy("stratum").orderBy("step")      # at most 1000 steps a rule
    seen = counts.where("step IS NOT NULL").withColumn("k", F.sum("n").over(up)).select("stratum", F.col("step").alias("at"), "k")
    over = (base.select("stratum", "bar").join(seen, "stratum")
            .groupBy("stratum").agg(F.min(F.when(F.col("k") > F.col("bar"), F.col("at"))).alias("stop"),
                                    F.coalesce(F.max(F.when(F.col("k") <= F.col("bar"), F.col("k"))), F.lit(0)).alias("rejected")))
    return (base.join(over, "stratum", "left")
            .withColumn("step", F.when(F.col("bar") < 0, 0).otherwise(F.coalesce(F.col("stop") - 1, "steps")).cast("long"))
            .withColumn("rejected", F.coalesce("rejected", F.lit(0))).drop("stop", "steps"))


def cutoffs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The certificate: stratum, rule, cutoff in force (a document is rejected above it; 1000:
    not in force), n (good holdout documents), rejected, and bound: the exact upper bound of
    the stratum's share of falsely rejected documents, valid for all strata together."""
    table = _certificate(cut_lineage(statistics(docs)), labels)
    bound = F.udf(lambda k, n, s: upper_bound(k, n, DELTA / s), "double")
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.greatest(
        F.col(f"c{k}"), F.lit(1000) - F.greatest(F.lit(0), F.col("step") - F.col(f"s{k}"))).alias("cutoff"), F.col(f"s{k}").alias("s"))
        for k, r in enumerate(RULES)]))
    return (table.select("stratum", "n", "rejected", bound("rejected", "n", "strata").alias("bound"), rules.alias("x"))
            .where("x.s IS NOT NULL").select("stratum", "x.rule", F.col("x.cutoff").cast("int").alias("cutoff"), "n", "rejected", "bound"))


def _certificate(stats: DataFrame, labels: DataFrame) -> DataFrame:
    known = cut_lineage(labelled(stats, labels))
    return cut_lineage(certified(known, cut_lineage(paths(proposals(known)))))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Texts are measured once; what follows reads the small table of statistics."""
    stats = cut_lineage(statistics(docs))
    table = _certificate(stats, labels)
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEATS * F.col("n_words"))
    rejected = F.coalesce(step_of() <= F.col("step"), F.lit(False))
    return (stats.withColumn("stratum", stratum_of()).join(small(table), "stratum", "left")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    failed.alias("base_failed"), (~failed & ~rejected).alias("kept")))


def _class_sql(chars: bytes) -> str:
    return "[" + "".join(f"\\x{c:02x}" for c in chars) + "]"


def _share_sql(chars: bytes, of: str, most: str = "") -> str:
    return f"least(1000, 1000 * (length(t) - length(regexp_replace(t, '{_class_sql(chars)}', '', 'g'))) // greatest({of}, 1))"


_STEP_SQL = "least(" + ", ".join(f"CASE WHEN {r} > c{k} THEN s{k} + 1001 - {r} END" for k, r in enumerate(RULES)) + ")"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce('s' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (
    SELECT row, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, gram) > 1 AS twice FROM (
    SELECT row, i, [word, {', '.join(f'lead(word, {k}) OVER o' for k in range(1, WINDOW))}] AS gram, lead(i, {WINDOW - 1}) OVER o AS fin
    FROM w WINDOW o AS (PARTITION BY row ORDER BY i)) WHERE fin IS NOT NULL),
n AS (SELECT row, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY row),
r AS (SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM g, range(0, {WINDOW}) x(k) WHERE twice GROUP BY row),
ln AS (SELECT row, count(*) AS lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY row),
b AS (SELECT row, doc_id, stratum, t, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
    length(t) - length(regexp_replace(t, '{_class_sql(SYMBOLS)}', '', 'g')) AS n_symbols, coalesce(lines, 0) AS lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n USING (row) LEFT JOIN r USING (row) LEFT JOIN ln USING (row)),
s AS (SELECT *, {_share_sql(SYMBOLS, 'word_chars')} AS symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS repeats,
    1000 * n_dup_lines // greatest(lines, 1) AS lines_, {_share_sql(CAPITALS, f"(length(t) - length(regexp_replace(t, '{_class_sql(LETTERS)}', '', 'g')))")} AS capitals,
    {_share_sql(PUNCTUATION, 'word_chars')} AS punctuation, least(1000, 10 * word_chars // greatest(n_words, 1)) AS length_ FROM b),
q AS (SELECT * EXCLUDE (lines, lines_, length_), lines_ AS lines, length_ AS length FROM s),
lab AS (SELECT doc_id, max(quality) > 0 AS good, substr(md5(doc_id::VARCHAR), 1, 1) >= '8' AS holdout
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT q.*, good, holdout FROM q JOIN lab USING (doc_id)),
v AS (SELECT stratum, rule, value, sum(CASE WHEN good THEN -{GOOD_COST} ELSE 1 END) AS worth FROM (
    {' UNION ALL '.join(f"SELECT stratum, good, {i} AS rule, {r} AS value FROM k WHERE NOT holdout" for i, r in enumerate(RULES))}) GROUP BY ALL),
c AS (SELECT stratum, rule, value, sum(worth) OVER o AS gain, coalesce(lead(value) OVER o, 0) AS below
  FROM v WINDOW o AS (PARTITION BY stratum, rule ORDER BY value DESC)),
p AS (SELECT stratum, rule, gain, (value - 1 + below) // 2 AS cutoff FROM c WHERE gain >= {MIN_GAIN} AND value > 0
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, value DESC) = 1),
po AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS place FROM p),
pw AS (SELECT stratum, {', '.join(f'max(CASE WHEN rule = {i} THEN cutoff END) AS c{i}, max(CASE WHEN rule = {i} THEN place END) AS p{i}' for i in range(len(RULES)))}
  FROM po GROUP BY stratum),
ad AS (SELECT stratum, least({', '.join(f'CASE WHEN {r} > c{i} THEN p{i} END' for i, r in enumerate(RULES))}) AS place,
    sum(CASE WHEN good THEN -{GOOD_COST} ELSE 1 END) AS adds FROM k JOIN pw USING (stratum) WHERE NOT holdout GROUP BY ALL),
ps AS (SELECT po.*, coalesce(sum(1000 - cutoff) OVER (PARTITION BY stratum ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM po JOIN ad USING (stratum, place) WHERE adds >= {MIN_GAIN}),
path AS (SELECT stratum, {', '.join(f'max(CASE WHEN rule = {i} THEN cutoff END) AS c{i}, max(CASE WHEN rule = {i} THEN start END) AS s{i}' for i in range(len(RULES)))},
    sum(1000 - cutoff) AS steps FROM ps GROUP BY stratum),
h AS (SELECT stratum, step, count(*) OVER (PARTITION BY stratum ORDER BY step NULLS LAST RANGE UNBOUNDED PRECEDING) AS seen, count(*) OVER (PARTITION BY stratum) AS n
  FROM (SELECT stratum, {_STEP_SQL} AS step FROM k JOIN path USING (stratum) WHERE holdout AND good)),
bar AS (SELECT *, list_sum(list_transform(range(0, seen + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({ALPHA}::DOUBLE) + (n - i) * ln(1 - {ALPHA}::DOUBLE)))) <= {DELTA} / (SELECT count(*) FROM path) AS fine FROM h WHERE step IS NOT NULL),
z AS (SELECT stratum, pow(1 - {ALPHA}::DOUBLE, max(n)) <= {DELTA} / (SELECT count(*) FROM path) AS any_ FROM h GROUP BY stratum),
cert AS (SELECT path.*, CASE WHEN coalesce(any_, false) THEN coalesce(stop - 1, steps) ELSE 0 END AS step
  FROM path LEFT JOIN z USING (stratum) LEFT JOIN (SELECT stratum, min(step) AS stop FROM bar WHERE NOT fine GROUP BY stratum) USING (stratum)),
f AS (SELECT q.*, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_REPEATS} * n_words AS base_failed,
    coalesce({_STEP_SQL} <= step, false) AS rejected FROM q LEFT JOIN cert USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f
"""
