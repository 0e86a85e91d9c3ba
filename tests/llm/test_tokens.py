import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedlens.llm import tokens
from helpers import DOCS, awkward, doc, no_docs

PATH = tokens.default_tokenizer()
THEIRS = Tokenizer.from_file(PATH)


def ids(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_tokenizers_library(text):
    assert tokens.encoder(PATH)(text) == ids(text)


def test_ids_of_odd_texts():
    for t in ("a<|endoftext|>b", "  x\n\n y\t", "I'LL don't 's", "a" * 5000, "\u0000\x85 ", "12 345,6", "naïve 你好 😀"):
        assert tokens.encoder(PATH)(t) == ids(t)


def test_histogram(spark):
    docs = awkward(spark, [doc(20 + i, "word " * (i % 5 * 700)) for i in range(30)])
    lengths = [len(ids(r["text"])) for r in docs.select("text").collect()]
    got = {r["length"]: r for r in tokens.length_histogram(docs, PATH).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["n_docs"] == lengths.count(n) and r["n_tokens"] == n * lengths.count(n)
        assert r["docs_from"] == sum(x >= n for x in lengths)
        assert r["tokens_from"] == sum(x for x in lengths if x >= n)
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert abs(r["share_upto"] - sum(x <= n for x in lengths) / len(lengths)) < 1e-12
    limits = {r["limit"]: r for r in tokens.totals_at(tokens.length_histogram(docs, PATH), [1, 512, 1 << 20]).collect()}
    assert limits[512]["truncated_total"] == sum(min(x, 512) for x in lengths)
    assert limits[512]["n_longer"] == sum(x > 512 for x in lengths)
    assert limits[1 << 20]["truncated_total"] == sum(lengths) and limits[1 << 20]["n_longer"] == 0
    histogram = tokens.length_histogram(docs, PATH)
    every = [0, *range(1, max(lengths), 997), *lengths]
    got = {r["limit"]: (r["n_longer"], r["truncated_total"]) for r in tokens.totals_at(histogram, sorted(set(every))).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in every}
    shares = [0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["share"]: r["length"] for r in tokens.quantiles(histogram, shares).collect()}
    assert got == {q: min(x for x in lengths if sum(y <= x for y in lengths) / len(lengths) >= q) for q in shares}
    none = tokens.length_histogram(no_docs(spark), PATH)
    assert tuple(tokens.totals_at(none, [5]).first()) == (5, 0, 0) and tuple(tokens.quantiles(none, [0.5]).first()) == (0.5, None)
    assert tokens.totals_at(histogram, []).count() == tokens.quantiles(histogram, []).count() == 0
    assert tokens.length_histogram(no_docs(spark), PATH).count() == 0


def test_windows_are_filled():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 1024, 3000)
    windows, fills = tokens.fill_windows(n)
    assert sorted(i for w in windows for i in w) == list(range(3000))
    assert all(sum(n[i] for i in w) == f <= 1024 for w, f in zip(windows, fills))
    assert sum(fills) / (1024 * len(fills)) > 0.99
    assert tokens.fill_windows(np.zeros(0, dtype=np.int64)) == ([], [])


def check_packing(docs):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append([*ids(r["text"]), 0])
    rows = tokens.pack(docs, PATH).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
        assert any(len(t) == r["doc_tokens"] and zlib.crc32(np.array(t[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes())
                   == r["ids_crc32"] for t in texts[r["doc_id"]])
    total = sum(len(t) for ts in texts.values() for t in ts)
    assert sum(r["length"] for r in rows) == total
    covered = defaultdict(list)
    for r in rows:
        covered[r["doc_id"]].append((r["start"], r["length"]))
    for doc_id, ts in texts.items():
        want = defaultdict(int)
        for t in ts:
            for i in range(len(t)):
                want[i] += 1
        got = defaultdict(int)
        for s, n in covered[doc_id]:
            for i in range(s, s + n):
                got[i] += 1
        assert want == got
    padded = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        fill = 0
        for r in pieces:
            assert r["offset"] == fill
            fill += r["length"]
        assert 0 < fill <= 1024
        padded += 0 if fill & (fill - 1) == 0 else 1024 - fill
    return total, padded


def test_packing(spark):
    total, padded = check_packing(awkward(spark).coalesce(1))
    assert padded < 1024
    rng = np.random.default_rng(1)
    many = [doc(i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 1500, 400))]
    total, padded = check_packing(spark.createDataFrame(many, DOCS).coalesce(2))
    assert padded <= 2048 and padded < 0.02 * total
    assert tokens.pack(no_docs(spark), PATH).count() == 0


def test_packing_holds_few_remainders(spark, monkeypatch):
    monkeypatch.setattr(tokens, "HELD", 16)  # pickled with the function in local tests: only the driver's value counts
    total, padded = check_packing(spark.createDataFrame([doc(i, "w " * (600 + i % 3)) for i in range(100)], DOCS).coalesce(1))
    assert padded < 1024


def test_windows_of_each_tier():
    rng = np.random.default_rng(5)
    tiers = tokens.tiers_of(1024)
    n = rng.integers(1, 300, 2000)
    windows, fills = tokens.fill_windows(n, 1024, tiers)
    sizes = [tokens.tier_of(n[w[0]], tiers) for w in windows]
    assert set(sizes) == {512, 256, 128} and sorted(i for w in windows for i in w) == list(range(2000))
    assert all(sum(n[i] for i in w) == f <= s for w, f, s in zip(windows, fills, sizes))
    assert all(tokens.tier_of(n[i], tiers) < s for w, s in zip(windows, sizes) if s > 128 for i in w[1:])
    cut = tokens.cut_windows(n.tolist(), tiers)
    assert all(sum(x[2] for x in w) == tokens.tier_of(w[0][2], tiers) for w in cut[:-1])
    covered = defaultdict(list)
    for i, start, size in (x for w in cut for x in w):
        covered[i].extend(range(start, start + size))
    assert all(sorted(covered[i]) == list(range(k)) for i, k in enumerate(n))


def test_packed_tiers_and_step_groups(spark):
    rng = np.random.default_rng(2)
    many = [doc(i, "word " * int(n)) for i, n in enumerate(rng.integers(0, 1500, 300))]
    many += [doc(1000 + i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 400, 1200))]
    docs = spark.createDataFrame(many, DOCS).repartition(12)
    check_packing(docs)
    sequences = defaultdict(list)
    for r in tokens.pack(docs, PATH).collect():
        sequences[r["sequence_id"]].append(r)
    load = defaultdict(lambda: [0] * tokens.STEP_GROUPS)
    short = defaultdict(int)
    for sid, pieces in sequences.items():
        (tier,), (group,) = {r["tier"] for r in pieces}, {r["step_group"] for r in pieces}
        fill = sum(r["length"] for r in pieces)
        assert fill <= tier
        load[tier][group] += fill
        short[sid >> tokens.TASK_SHIFT] += fill < tier
    assert set(load) == set(tokens.TIERS) and max(short.values()) == 1
    assert all(max(x) - min(x) <= tier for tier, x in load.items())


def test_step_groups_are_dealt_over_all_tasks():
    counts = [(task, tier, task % 3, 0 if tier != 512 else 257 + task) for task in range(100) for tier in (1024, 512)]
    load = defaultdict(lambda: [0] * tokens.STEP_GROUPS)
    for (_, _, full, ids), (task, tier, groups, g) in zip(sorted(counts, key=lambda c: (-c[1], c[0])), tokens.deal_groups(counts)):
        assert sorted(groups) == list(range(tokens.STEP_GROUPS))
        for k in range(full):
            load[tier][groups[k]] += tier
        load[tier][g] += ids
    assert all(max(x) - min(x) <= tier for tier, x in load.items())
    assert tokens.deal_groups([]) == []
