import random
import re

import pytest
from feedlens.llm import quality
from helpers import LONG, awkward, doc, no_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    """The contract's statistics, written out."""
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "ü", "c\n", "#", "Dé|", "\t"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [" ".join(f"w{i}" for i in range(9000)) + " x y z u v x y z u v", LONG + "\n" + LONG, "a" * 3_000_000, "b c " * 700_000]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], awkward(spark).schema)
    got = {r["doc_id"]: tuple(r)[2:7] for r in quality.statistics(docs).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_binomial():
    def tail(k, n, p):
        from math import comb
        return sum(comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
    for n in (1, 7, 60):
        for p in (0.03, 0.5, 0.9):
            for k in range(n + 1):
                assert quality.binomial_tail(k, n, p) == pytest.approx(tail(k, n, p), abs=1e-12)
    for n in (1, 50, 100, 700):
        k = quality.allowed(n, 0.05, 0.01)
        assert (k < 0 and tail(0, n, 0.05) > 0.01) or (tail(k, n, 0.05) <= 0.01 < tail(k + 1, n, 0.05))
    assert quality.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** 0.01)
    assert 0 <= quality.binomial_tail(10_000, 10 ** 9, 0.05) < 1e-12 and quality.binomial_tail(900, 1000, 0.01) == pytest.approx(1)


def clean(rng, n=40):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def tables(spark, rng, n=1200, langs=("en", "de")):
    docs, labels = [], []
    for i in range(n):
        text, bad = clean(rng), i % 6 == 0
        if bad:
            text = text.replace(" ", " ### ") if i % 12 else text.upper()
        docs.append(doc(i, text, langs[i // 12 % len(langs)]))
        if i % 3 != 1:
            labels.append((i, 0 if bad else 1, 0, "clash"))
    return docs, labels


LABELS = "doc_id long, quality int, toxic int, text string"


def judged(spark, docs, labels):
    d, lab = spark.createDataFrame(docs, awkward(spark).schema), spark.createDataFrame(labels, LABELS)
    return {r["doc_id"]: r for r in quality.judge(d, lab).collect()}, d, lab


def test_junk_goes_and_clean_documents_stay(spark):
    rng = random.Random(1)
    docs, labels = tables(spark, rng)
    docs += [doc(5000 + i, clean(rng).replace(" ", " # "), "xx") for i in range(20)]     # a stratum without labels
    got, d, lab = judged(spark, docs, labels)
    for i in range(1200):
        assert got[i]["kept"] == (i % 6 != 0), i
    assert all(got[5000 + i]["kept"] for i in range(20))
    sure = quality.cutoffs(d, lab).collect()
    assert {r["stratum"] for r in sure} == {"sen", "sde"} and {"symbols", "capitals"} <= {r["rule"] for r in sure}
    assert all(r["rejected"] == 0 and r["bound"] <= quality.ALPHA and r["n"] > 100 for r in sure)


def test_holdout_stops_a_cutoff_that_would_reject_too_much(spark):
    """A tenth of the good documents are in capitals, but in the holdout half only: the
    selection half proposes the rule, the holdout half turns it down."""
    import hashlib
    rng = random.Random(2)
    docs, labels = tables(spark, rng, langs=("en",))
    for k, (i, q, _, _) in enumerate(labels):
        if q and hashlib.md5(str(i).encode()).hexdigest()[0] >= "8" and k % 10 == 1:
            docs[i] = doc(i, docs[i][1].upper(), "en")
    got, d, lab = judged(spark, docs, labels)
    sure = {r["rule"]: r for r in quality.cutoffs(d, lab).collect()}
    assert all(r["bound"] <= quality.ALPHA for r in sure.values())
    assert sure["symbols"]["cutoff"] < 600 and sure["capitals"]["cutoff"] == 1000
    assert all(got[i]["kept"] for i, q, _, _ in labels if q)


def test_limit_holds_for_rules_that_tell_nothing_apart(spark):
    """Labels by chance: whatever is proposed, no stratum loses more than the limit."""
    rng = random.Random(3)
    docs = [doc(i, clean(rng).upper() if rng.random() < 0.3 else clean(rng), rng.choice(["en", "de", None])) for i in range(900)]
    labels = [(i, int(rng.random() < 0.5), 0, "") for i in range(900)]
    got, d, lab = judged(spark, docs, labels)
    good = [got[i]["kept"] for i, q, _, _ in labels if q]
    assert sum(good) >= (1 - quality.ALPHA) * len(good)


def test_awkward_rows(spark):
    docs = awkward(spark)
    for labels in ([], [(1, 1, 0, "x"), (1, 0, 0, "x"), (None, 0, 1, "x"), (2, None, 0, "x"), (5, 0, 0, "x"), (77, 1, 1, "x")]):
        got = quality.judge(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == 12
        by = {r["doc_id"]: r for r in got}
        assert by[2]["n_words"] == by[3]["n_words"] == 0 and by[2]["base_failed"] and not by[2]["kept"]
        assert by[5]["n_words"] == 20_000 and all(r["base_failed"] or r["kept"] for r in got)
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(tuple(r)[1:6] == plain(texts[r["doc_id"]]) for r in got if r["doc_id"])
    assert quality.judge(no_docs(spark), spark.createDataFrame([], LABELS)).count() == 0
