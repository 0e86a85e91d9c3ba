import math
import random
import re

import numpy as np
import pytest
from feedlens.llm import search
from helpers import awkward, doc, no_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score long"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    """The contract, every document against every item."""
    ts = [(i, terms(t)) for i, t in docs]
    ts = [(i, t) for i, t in ts if t]
    n_docs, total = len(ts), sum(len(t) for _, t in ts)
    df = {}
    for _, t in ts:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for x, f in df.items()}
    asked = {}
    for i, t in items:
        asked.setdefault(i, []).extend(terms(t))
    out = []
    for i, q in asked.items():
        scores = []
        for d, t in ts:
            m = 100 - 75 + 75 * len(t) * n_docs // total
            tf = {x: t.count(x) for x in set(q) & set(t)}
            s = sum(w[x] * (10 ** 9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in q if x in tf)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def words(rng, n, vocabulary):
    return " ".join(vocabulary[min(int(rng.expovariate(0.02)), len(vocabulary) - 1)] for _ in range(n))


def case(seed, n=700):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abÄçx')}{i}" + rng.choice(["", "É", "q9"]) for i in range(600)]
    docs = [doc(i, words(rng, rng.randrange(1, 60), vocabulary).replace(" ", rng.choice([" ", "-", "\n", "_"]))) for i in range(n)]
    docs += [doc(2000 + i, docs[5][1]) for i in range(300)]          # a hot group of copies, all tied
    items = [(i, words(rng, rng.randrange(1, 25), vocabulary).upper(), 0) for i in range(40)]
    items += [(100, docs[5][1], 0), (101, "nothing known", 0), (102, " ... ", 0), (103, None, 0), (None, docs[9][1], 0),
              (104, "a a a " + docs[7][1], 0), (104, docs[8][1], 0)]
    return docs, items


@pytest.mark.parametrize("seed,block,cells,leaf", [(1, 100_000, 2 ** 21, 16), (2, 60, 2 ** 10, 2)])
def test_equals_every_document_against_every_item(spark, monkeypatch, seed, block, cells, leaf):
    """One block and one batch a task; then several blocks and many small batches."""
    monkeypatch.setattr(search, "ITEM_TERMS", block)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "LEAF", leaf)
    docs, items = case(seed, 700 if block > 60 else 300)
    got = search.search(spark.createDataFrame(docs, awkward(spark).schema).repartition(6), spark.createDataFrame(items, ITEMS))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain([d[:2] for d in docs], [i[:2] for i in items])


def test_pairs_are_pruned_and_nothing_is_lost():
    """The trees alone: far fewer documents are scored than there are pairs, the best are the
    same, with whole-number sums in doubles and in 64-bit integers."""
    rng = np.random.default_rng(3)
    size, n = 400, 2000
    weights = rng.integers(1, 9000, size)
    rows = [(i, int(t), 1) for i in range(50) for t in rng.choice(size, 12, replace=False)]
    docs = [np.sort(rng.choice(np.arange(k % 40 * 10, k % 40 * 10 + 10), 6, replace=False)) for k in range(n)]
    docs.sort(key=lambda t: tuple(t))
    impact = [rng.integers(1, 1_000_000, len(t)) for t in docs]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in docs])])
    found = []
    for exact in (True, False):
        items = search.Items(rows, weights)
        items.exact = exact
        finder = search.Finder(items, np.zeros(50, np.int64), 10)
        finder.search(search.Batch(np.arange(n), np.ones(n, bool), starts, np.concatenate(docs), np.concatenate(impact), size, exact))
        assert finder.scored < 0.5 * n * 50
        found.append(finder.rows().to_pydict())
    assert found[0] == found[1]
    dense = np.zeros((n, size), np.int64)
    for k, (t, u) in enumerate(zip(docs, impact)):
        dense[k, t] = u
    for i, item in enumerate(items.ids):
        q = np.zeros(size, np.int64)
        for it, t, _ in rows:
            if it == item:
                q[t] = weights[t]
        s = dense @ q
        want = sorted((-int(x), k) for k, x in enumerate(s) if x > 0)[:10]
        assert [(-sc, d) for it, d, sc in zip(*(found[0][c] for c in ("item", "doc_id", "score"))) if it == i] == want


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "the cat", 5), (2, "über 你好", 5), (3, "w0x0 123", 5), (4, None, 5), (5, "", 5)], ITEMS)
    docs = awkward(spark, [doc(11, "x1 " * 500_000 + "cat")])
    got = [tuple(r) for r in search.search(docs, items).collect()]
    assert sorted(got, key=str) == plain([(r["doc_id"], r["text"]) for r in docs.collect()],
                                         [(r["item_id"], r["text"]) for r in items.collect()])
    assert search.search(no_docs(spark), items).count() == 0
    assert search.search(docs, spark.createDataFrame([], ITEMS)).count() == 0
