import math
from collections import defaultdict

import pytest

from feedlens.llm import mixing
from helpers import DOCS, awkward, doc, no_docs


def brute_targets(sizes):
    """Clamp and reshare until none is above, as the rule is worded."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * share > 2 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * share for s in free}
        fixed |= {s: 2 * sizes[s] for s in over}


def check(rows):
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, want in brute_targets(size).items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= 2, s


def marked(spark, docs):
    ids = docs.select("doc_id", "source").distinct()
    return mixing.mix(docs).join(ids, "doc_id").collect()


def test_targets_and_taken_words(spark):
    rows = [doc(i, "x " * (i * 7 % 50 + 1), "en", s) for i, s in enumerate(
        ["big"] * 300 + ["mid"] * 60 + ["low"] * 9 + ["q"] * 40 + [None] * 30 + ["one"])]
    docs = spark.createDataFrame(rows, DOCS)
    got = marked(spark, docs)
    assert len(got) == len(rows)
    check(got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, marked(spark, docs.repartition(7))), key=str)


def test_mixed_corpus_has_the_words_that_were_marked(spark):
    rows = [doc(i, f"a{i} b c\td  e", "en", s) for i, s in enumerate(["a"] * 50 + ["b"] * 20 + ["c"] * 7)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = defaultdict(int)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        got[r["doc_id"]] += len(r["text"].split())
        assert r["words"] == "clash" and r["text"].split()[0] == f"a{r['doc_id']}"
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_awkward_rows(spark):
    got = mixing.mix(awkward(spark)).collect()
    assert len(got) == 12
    by = defaultdict(int)
    for r in got:
        assert r["size"] is not None and 0 <= r["taken"] <= 2 * r["size"]
        by[r["target"]] += r["taken"]
    assert all(abs(k - v) <= 3 for k, v in by.items())
    assert mixing.mix_documents(awkward(spark)).count() >= 2
    assert mixing.mix(no_docs(spark)).count() == 0 and mixing.mix_documents(no_docs(spark)).count() == 0


def test_sources_without_words(spark):
    docs = spark.createDataFrame([doc(1, None, "en", "a"), doc(2, "", "en", "b")], DOCS)
    got = mixing.mix(docs).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2 or math.isclose(got[0]["target"], 0)
