import random

import numpy as np
import pytest
import xxhash

from feedlens.llm import simhash
from feedlens.llm.common import components
from helpers import DOCS, awkward, doc, no_docs


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes) and hashes)


def brute_roots(fps, r):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= r:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint():
    for t in ("", "one", "Two Words", "a b c d A B C", "x y z Ü ü É é", "the cat sat on the mat " * 30):
        assert simhash.fingerprint(t.encode()) == plain(t)


def clustered(n, seed):
    r = random.Random(seed)
    centres = [r.getrandbits(64) for _ in range(n // 8)]
    out = [r.getrandbits(64) for _ in range(n // 2)]
    while len(out) < n:
        c = r.choice(centres[:5]) if r.random() < 0.5 else r.choice(centres)
        for _ in range(r.randrange(6)):
            c ^= 1 << r.randrange(64)
        out.append(c)
    return out


@pytest.mark.parametrize("shard_rows,task_rows", [(10 ** 6, 10 ** 6), (40, 10 ** 6), (40, 30)])
def test_components_equal_brute_force(spark, monkeypatch, shard_rows, task_rows):
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    fps = sorted(set(clustered(700, 4)))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, shard_rows, task_rows))
    by = {r["node"]: r["root"] for r in got.collect()}
    want = brute_roots(fps, 2)
    mine = [by.get(x, x) for x in signed]
    groups = lambda labels: {frozenset(i for i, y in enumerate(labels) if y == x) for x in set(labels)}
    assert groups(mine) == groups(want)


def test_dense_group_gives_few_links(spark):
    centre = 0x0123456789ABCDEF
    fps = [centre] + [centre ^ (1 << a) for a in range(64)] + [centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    a, b = simhash.shard_links(np.array(fps, dtype=np.uint64), np.ones(len(fps), bool), np.ones(len(fps), bool), 2)
    assert len(a) == len(fps) - 1


def test_long_chains(spark):
    n = 400
    order = list(range(n))
    random.Random(2).shuffle(order)
    got = components(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")).collect()
    assert {r["node"] for r in got} == set(range(n)) and {r["root"] for r in got} == {0}


def test_documents(spark):
    base = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore " * 8
    rows = [doc(10, base), doc(11, base.upper()), doc(12, base + "x"), doc(13, "something else entirely here"), doc(14, ""), doc(15, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {i: plain(t) for i, t in ((r[0], r[1]) for r in rows)}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{x:016x}" for i, x in fps.items()}
    ids = sorted(fps)
    want = brute_roots([fps[i] for i in ids], 2)
    assert [got[i]["component_id"] for i in ids] == [ids[w] for w in want]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({ids[w] for w in want})


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == 12
    by = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"]}
    assert by[7] == by[1] == 1 and by[6] == by[5] == 5 and by[2] == by[3] == by[4] == 2
    kept = sorted(str(r["doc_id"]) for r in simhash.keep_one(docs).collect())
    assert kept == sorted(["1", "2", "5", "8", "9", "None"])
    assert simhash.near_duplicates(no_docs(spark)).count() == 0 and simhash.keep_one(no_docs(spark)).count() == 0


def test_components_of_hubs_and_chains(spark):
    """A hub with most links, a long chain through it, separate pairs."""
    from feedlens.llm.common import components
    links = [(0, i) for i in range(1, 400)] + [(399 + i, 400 + i) for i in range(60)] + [(1000, 1001), (1003, 1002), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(460)} | {1000: 1000, 1001: 1000, 1002: 1002, 1003: 1002}
