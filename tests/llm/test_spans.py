import hashlib
import random
from collections import Counter

import pytest

from feedlens.llm import spans
from helpers import DOCS, awkward, doc, no_docs


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append([x for j, x in enumerate(w) if j not in gone])
    return words, out


def check(spark, docs, window, k):
    rows = docs.select("doc_id", "text").collect()
    words, kept = brute([r["text"] for r in rows], window)
    want = Counter((r["doc_id"], len(w), len(w) - len(x), hashlib.sha256(b" ".join(x)).hexdigest())
                   for r, w, x in zip(rows, words, kept))
    got = Counter(map(tuple, spans.dedup_report(docs, window, k).collect()))
    assert got == want
    after = spans.remove_repeats(docs, window, k)
    assert after.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in after.collect())
    assert texts == Counter((r["doc_id"], b" ".join(x).decode() if len(w) > len(x) else r["text"])
                            for r, w, x in zip(rows, words, kept))


@pytest.mark.parametrize("seed,vocabulary,window,k", [(1, 2, 5, 2), (2, 3, 6, 3), (3, 12, 7, 3), (4, 400, 9, 4), (5, 1, 5, 2)])
def test_random_texts(spark, seed, vocabulary, window, k):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    texts = [" ".join(word() for _ in range(r.randrange(0, 40))) for _ in range(60)]
    passage = [" ".join(word() for _ in range(14)) for _ in range(3)]
    texts += [f"{word()} {r.choice(passage)} {word()} {word()}" for _ in range(30)]
    texts += [texts[1]] * 3
    check(spark, spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS), window, k)


def brute_unitigs(texts, window):
    """(text, first window, windows) of every occurrence of every unitig of the window graph."""
    words = [t.split() for t in texts]
    walks = [[tuple(w[i:i + window]) for i in range(len(w) - window + 1)] for w in words]
    n = Counter(x for walk in walks for x in walk)
    pair = Counter(p for walk in walks for p in zip(walk, walk[1:]))
    joined = {p for p, m in pair.items() if m == n[p[0]] == n[p[1]]}
    out = []
    for t, walk in enumerate(walks):
        first = 0
        for i, x in enumerate(walk):
            if i + 1 == len(walk) or (x, walk[i + 1]) not in joined:
                if n[x] > 1:
                    out.append((t, first, i + 1 - first))
                first = i + 1
    return Counter(out)


@pytest.mark.parametrize("seed,vocabulary,window,k", [(1, 2, 5, 2), (2, 3, 6, 3), (3, 30, 7, 3), (4, 500, 9, 4), (5, 1, 5, 2)])
def test_unitigs_are_those_of_the_window_graph(spark, seed, vocabulary, window, k):
    r = random.Random(seed)
    word = lambda: f"w{r.randrange(vocabulary)}"
    passages = [" ".join(word() for _ in range(n)) for n in (12, 40, 300)]
    texts = [" ".join([*(word() for _ in range(r.randrange(30))), r.choice(passages), *(word() for _ in range(r.randrange(30)))])
             for _ in range(25)]
    texts += [passages[2].replace(" ", " x ", 1), passages[2].rsplit(" ", 100)[0], passages[2] + " y " + passages[1]]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate(texts)], DOCS)
    got = Counter((r["id"], r["first"], r["windows"]) for r in spans.unitig_spans(docs, window, k).collect())
    assert got == brute_unitigs(texts, window)


def test_one_passage_in_most_rows_is_one_span_each(spark):
    """Long repeated passage: pointer jumping over some 70 strands ends in one unitig."""
    r = random.Random(4)
    passage = " ".join(f"p{r.randrange(10 ** 9)}" for _ in range(1000))
    rows = [doc(i, f"a{i} b{i} {passage} c{i}") for i in range(40)] + [doc(100, "a b c")]
    got = spans.unitig_spans(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r["id"], r["first"], r["windows"]) for r in got) == [(i, 2, 1000 - spans.WINDOW + 1) for i in range(40)]


def test_production_window(spark):
    r = random.Random(9)
    fresh = lambda n: " ".join(f"u{r.randrange(10 ** 9)}" for _ in range(n))
    passage, almost, line = fresh(60), fresh(34), fresh(20)
    rows = [doc(i, f"{fresh(30 + i)} {passage} {fresh(10)}") for i in range(5)]
    rows += [doc(10 + i, f"{fresh(40)}\n{almost}\n{fresh(40)}") for i in range(4)]
    rows += [doc(20 + i, f"{line}  {fresh(50)}\t{line}") for i in range(3)]
    rows += [doc(30, passage.upper()), doc(31, f"{fresh(5)} {passage.split(' ', 20)[-1]}")]
    docs = spark.createDataFrame(rows, DOCS)
    check(spark, docs, spans.WINDOW, spans.K)
    got = {r["doc_id"]: r["n_removed"] for r in spans.dedup_report(docs).collect()}
    assert [got[i] for i in range(5)] == [60] * 5 and got[10] == 0 and got[20] == 0 and got[30] == 0 and got[31] == 40


def test_awkward_rows(spark):
    check(spark, awkward(spark), spans.WINDOW, spans.K)
    check(spark, awkward(spark), 4, 2)
    assert spans.dedup_report(no_docs(spark)).count() == 0 and spans.remove_repeats(no_docs(spark)).count() == 0
