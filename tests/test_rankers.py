"""Sentence rankers (T19) against the same rankings in plain numpy."""
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedlens.operators import rankers as R
from feedlens.operators import summarize as SM


def tokens(sentence):
    return [t for t in re.split(r"[^\w]+", sentence.lower()) if t and t not in R.STOP_WORDS]


def split(text):
    return re.split(r"(?<=[.!?])\s+", text)


def matrix(toks):
    vocab = sorted({w for t in toks for w in t})
    at = {w: i for i, w in enumerate(vocab)}
    tf = np.zeros((len(toks), len(vocab)))
    for i, t in enumerate(toks):
        for w in t:
            tf[i, at[w]] += 1
    return tf


def walk(w, rounds=R.ROUNDS):
    row = w.sum(axis=1)
    s = np.ones(len(w))
    for _ in range(rounds):
        x = np.divide(s, row, out=np.zeros(len(w)), where=row > 1e-9)
        s = 1 - R.DAMPING + R.DAMPING * (w.T @ x)
    return s


def plain(algorithm, toks):
    tf = matrix(toks)
    if algorithm == "luhn":
        often = tf.sum(axis=0) >= 2
        return (tf * often).sum(axis=1) ** 2 / np.maximum(tf.sum(axis=1), 1)
    if algorithm == "textrank":
        has = tf > 0
        size = has.sum(axis=1)
        both = (has.astype(float) @ has.T).astype(float)
        den = np.log(1 + size)[:, None] + np.log(1 + size)[None, :]
        w = np.divide(both, den, out=np.zeros_like(both), where=den > 0)
        np.fill_diagonal(w, 0)
        return walk(w) * (size > 0)
    if algorithm == "lexrank":
        v = tf * (np.log(len(toks) / (1 + (tf > 0).sum(axis=0))) + 1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
        return walk((np.round(v @ v.T, 9) >= R.LEXRANK_COSINE).astype(float))
    u, s, vt = np.linalg.svd(tf.T, full_matrices=False)
    return np.sqrt(((s[:R.TOPICS, None] * vt[:R.TOPICS]) ** 2).sum(axis=0))


def texts(seed, n=12):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "of", "and"]
    out = []
    for _ in range(n):
        sents = [" ".join(words[min(int(rng.expovariate(0.12)), 42)] for _ in range(rng.randrange(1, 14))) + rng.choice(".!?")
                 for _ in range(rng.randrange(2, 25))]
        out.append(" ".join(sents))
    return [*out, "One two three. " * 9, "The of and. " * 12, "single sentence without an end " * 5, "... !!! ??? " * 12]


def named_scores(df, sents, scores):
    return scores.join(sents.select("g", "key").distinct(), "g").join(df.select("id", R.text_key("t").alias("key")), "key")


@pytest.mark.parametrize("algorithm", ["luhn", "textrank", "lexrank"])
def test_scores_equal_numpy(spark, algorithm):
    rows = [(i, t) for i, t in enumerate(texts(3))]
    df = spark.createDataFrame(rows, "id long, t string")
    sents = R.sentence_rows(df, "t")
    got = {}
    named = named_scores(df, sents, R.RANKERS[algorithm](sents))
    for r in named.collect():
        got[r["id"], r["k"]] = r["score"]
    for i, t in rows:
        toks = [tokens(s) for s in split(t)]
        if not any(toks):
            continue
        for k, want in enumerate(plain(algorithm, toks)):
            if toks[k]:
                assert got[i, k] == pytest.approx(float(want), abs=1e-9), (i, k)


def test_lsa_scores_near_the_exact_decomposition(spark, monkeypatch):
    monkeypatch.setattr(R, "LSA_ROUNDS", 30)
    rows = [(i, t) for i, t in enumerate(texts(4, 5))]
    df = spark.createDataFrame(rows, "id long, t string")
    sents = R.sentence_rows(df, "t")
    named = named_scores(df, sents, R.lsa(sents))
    got = {(r["id"], r["k"]): r["score"] for r in named.collect()}
    near = total = 0
    for i, t in rows:
        toks = [tokens(s) for s in split(t)]
        if any(toks):
            for k, want in enumerate(plain("lsa", toks)):
                if toks[k]:
                    total += 1
                    near += abs(got[i, k] - want) < 1e-2 * max(1.0, want)
    assert near >= 0.95 * total > 50      # subspaces with nearly equal singular values turn slowly


def test_links_below_the_threshold_are_told_by_tails(spark):
    """Cosines around 0.1, with frequent words that only count together."""
    rng = random.Random(8)
    sents = [" ".join(rng.sample([f"r{i}" for i in range(300)], 8) + rng.sample(["c1", "c2", "c3"], rng.randrange(4))) + "." for _ in range(60)]
    text = " ".join(sents)
    rows = R.sentence_rows(spark.createDataFrame([(text,)], "t string"), "t")
    got = {(r["i"], r["j"]) for r in R.cosine_links(rows).collect()}
    tf = matrix([tokens(s) for s in sents])
    v = tf * (np.log(len(sents) / (1 + (tf > 0).sum(axis=0))) + 1)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if round(float(v[i] @ v[j]), 9) >= 0.1}
    assert got == want and 0 < len(want) < 60 * 59 / 2


def test_summaries(spark):
    long = "Alpha beta gamma. " * 30
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "short text."), (5, "The of and. " * 12), (None, long), (6, texts(5, 1)[0])]
    df = spark.createDataFrame(rows, "id long, t string")
    for name in ("luhn", "textrank", "lexrank", "lsa"):
        out = SM.configure_summarizer(name).summarize(df, "id", "t", 60).collect()
        assert len(out) == len(rows)
        by = {r["id"]: r["summary"] for r in out}
        assert by[2] is None and by[3] == "" and by[4] == "short text." and by[5] == ("The of and. " * 12)[:500]
        assert by[1] == by[None] == "Alpha beta gamma. Alpha beta gamma. Alpha beta gamma."


def test_one_long_text_spreads_over_tasks(spark):
    """Groups are (text, word) and (text, sentence): 5,000 sentences of one text meet in no task."""
    rng = random.Random(6)
    text = " ".join(" ".join(f"v{min(int(rng.expovariate(0.01)), 900)}" for _ in range(9)) + "." for _ in range(5000))
    rows = R.sentence_rows(spark.createDataFrame([(text,)], "t string"), "t")
    assert rows.count() >= 5000
    spread = R.incidences(rows).repartition(8, "g", "term").groupBy(F.spark_partition_id()).count()
    assert spread.count() == 8 and spread.agg(F.max("count")).first()[0] < 0.4 * R.incidences(rows).count()
    scores = R.textrank(rows)
    assert scores.count() >= 4990 and scores.agg(F.sum("score")).first()[0] == pytest.approx(scores.count(), rel=1e-6)
    assert math.isfinite(R.luhn(rows).agg(F.sum("score")).first()[0])


@pytest.mark.parametrize("algorithm", ["luhn", "textrank", "lexrank", "lsa"])
def test_texts_are_dealt_once_and_no_round_writes(spark, algorithm, monkeypatch):
    """Copies of a text meet in one exchange; words, links and rounds are neither shuffled nor staged."""
    staged = []
    monkeypatch.setattr(R, "cut_lineage", lambda df: staged.append(df) or df)
    df = spark.createDataFrame([(t,) for t in texts(7, 4) * 2], "t string")
    best = R.best_sentences(R.text_rows(df, "t"), algorithm, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and not staged
    assert best.count() == 8 and best.where("best IS NULL").count() == 2      # two texts have no word


def test_work_is_linear_in_copies_of_a_word(spark):
    """One word in every sentence: its places are summed by sentence size, not pair by pair."""
    text = " ".join(f"common v{i} v{i + 1}." for i in range(20_000))
    rows = R.text_rows(spark.createDataFrame([(text,)], "t string"), "t")
    scores = rows.select(F.explode(R.scored(F.col("terms"), "textrank")).alias("s"))
    assert scores.count() == 20_000 and scores.agg(F.sum("s")).first()[0] == pytest.approx(20_000, rel=1e-6)
