import math
import zlib
from collections import Counter

import numpy as np
import pytest

from feedlens.llm import lm
from feedlens.llm.common import load
from helpers import DOCS, awkward, doc, no_docs


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def brute(rows):
    """Base and model scores from whole-corpus dictionaries; the weights by plain EM."""
    em = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 3

    def tables(docs):
        one, two = Counter(), Counter()
        for _, t in docs:
            w = lm.tokens(t)
            one.update(w)
            two.update(zip([None, *w[:-1]], w))
        return one, two, sum(one.values())

    def parts(one, two, n, size, u, w):
        c = one[b""] if u is None else one[u]
        return (math.ceil(math.log2(c + 1)), [two[u, w] / max(c, 1), one[w] / max(n, 1), 1 / size, float(not one[w])])

    train = [r for r in rows if not held(r[0])]
    one, two, n = tables(train)
    size = len(one) + 1
    fit = tables([r for r in train if not em(r[0])])
    events = Counter()
    for d, t in train:
        if em(d):
            w = lm.tokens(t)
            for u, x in zip([None, *w[:-1]], w):
                b, est = parts(*fit, size, u, x)
                events[b, *est] += 1
    weights = np.tile([0.3, 0.3, 0.1, 0.3], (lm.BUCKETS, 1))
    for _ in range(lm.ROUNDS if events else 0):
        total = np.full((lm.BUCKETS, 4), 0.01)
        for (b, *est), m in events.items():
            share = weights[b] * est
            total[b] += m * share / share.sum()
        weights = total / total.sum(axis=1, keepdims=True)
    out = []
    for d, t in rows:
        w = lm.tokens(t)
        model = 0.0
        for u, x in zip([None, *w[:-1]], w):
            b, est = parts(one, two, n, size, u, x)
            model += math.log10((weights[b] * est).sum()) if n else 0.0
        out.append((d, held(d), len(w), sum(one[x] > 0 for x in w), n,
                    sum(math.log10((one[x] + 1) / (n + size)) for x in w), model))
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    key = lambda x: tuple((y is None, y or 0) for y in x[:5]) + (round(x[5], 6),)
    got, want = sorted(map(tuple, lm.score(docs).collect()), key=key), sorted(brute(rows), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=0.02, abs=0.05)  # the weights are learned from binned estimates
    return got


@pytest.mark.parametrize("chunk", [lm.CHUNK_BYTES, 20_000])
def test_documents(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    got = check(load(spark, "/root/testdata/sf0.001", "documents"))
    unseen = [r for r in got if r[1]]
    assert sum(r[6] for r in unseen) > sum(r[5] for r in unseen)
    assert np.mean([r[6] > r[5] for r in unseen]) > 0.95


def test_awkward_rows(spark):
    check(awkward(spark))
    check(spark.createDataFrame([doc(i, f"a b c{i % 3} d") for i in range(50)], DOCS))
    assert lm.score(no_docs(spark)).count() == 0


def test_only_held_out_documents(spark):
    ids = [i for i in range(100) if held(i)][:3]
    got = lm.score(spark.createDataFrame([doc(i, "a b") for i in ids], DOCS)).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(0, 0, 0.0, 0.0)] * 3


def test_em_raises_the_likelihood():
    held_counts = [(3, -20, -40, 5.0), (3, lm.NEVER, -40, 9.0), (3, lm.NEVER, lm.NEVER, 2.0), (7, -10, -60, 30.0)]

    def like(w):
        p = lambda x: 0.0 if x == lm.NEVER else 10.0 ** (x / lm.BINS)
        return sum(n * math.log(w[b] @ [p(two), p(one), 1e-4, one == lm.NEVER]) for b, two, one, n in held_counts)
    learned = lm.learn(held_counts, 1e-4)
    assert like(learned) > like(lm.learn([], 1e-4)) and np.allclose(learned.sum(axis=1), 1)


def test_ranges_follow_the_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2 ** 64, 1000, dtype=np.uint64))
    own = lm.range_of(keys, 7)
    assert (np.diff(own) >= 0).all() and own.min() == 0 and own.max() == 6


def test_counts_beyond_32_bits():
    """Chunks whose counts of one word add up to more than 2 ** 32, kept whole on both sides."""
    import pyarrow as pa
    keys, n = np.array([5, 9], np.uint64), np.array([2 ** 32 - 1, 3], "<u4")
    row = lambda name, em: (0, name, em, 1, 2, lm.squeeze(np.diff(keys, prepend=np.uint64(0))), lm.squeeze(n))
    types = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows = [row("a", False), row("b", False), row("c", True), row("d", True), row("e", True)]
    got = lm.add_up(pa.table([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=lm.names_of(lm.KEYS)))
    total = got.filter(pa.compute.is_null(got["chunk"])).to_pylist()[0]
    assert (total["fit_n"], total["em_n"], total["known"]) == (2 * (2 ** 32 + 2), 3 * (2 ** 32 + 2), 2)
    one = got.filter(pa.compute.equal(got["chunk"], "a"))
    both = pa.concat_tables([one, one.set_column(3, "kind", pa.array([2], pa.int32()))])     # no bigrams in the fixture
    counts = lm.answers(both)
    assert counts[1, "fit"].tolist() == [2 * (2 ** 32 - 1), 6] and counts[1, "em"].tolist() == [3 * (2 ** 32 - 1), 9]
