import numpy as np

from feedlens.llm import ann
from feedlens.llm.common import load

SCHEMA = "vec_id long, embedding array<float>, label int, v string, part string, score string"


def brute(ids, x, k, every):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            s = (q * x).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 0, "clash", "clash", "clash") for i, v in zip(ids, x)], SCHEMA)


def test_recall(spark):
    df = load(spark, "/root/testdata/sf0.1", "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    want, got = brute(ids, x, 20, 20), answers(ann.search(df))
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    true = {int(i): v for i, v in zip(ids, x)}
    assert all(abs(s - (true[q] * true[v]).sum()) < 1e-12 for q, found in got.items() for v, s in found)


def test_copies_ties_and_blocks(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.standard_normal((400, 16)), 1).astype(np.float32).astype(np.float64)
    x[100:260] = x[100]
    ids = rng.permutation(400)
    got = answers(ann.search(frame(spark, ids, x), every=1, block_rows=16))
    want = brute(ids, x, 20, 1)
    copies = {int(i) for i in ids[100:260]}
    for q in copies:
        smallest = sorted(copies - {q})[:20]
        if {v for v, _ in want[q]} <= copies:
            assert [v for v, _ in got[q]] == smallest
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_rows_that_take_no_part(spark):
    good = [(i, [float(i), 1.0], 0, "", "", "") for i in range(1, 6)]
    bad = [(20, None, 0, "", "", ""), (40, [0.0, 0.0], 0, "", "", ""), (60, [None, 1.0], 0, "", "", ""), (None, [1.0, 1.0], 0, "", "", ""),
           (80, [float("nan"), 1.0], 0, "", "", ""), (100, [float("inf"), 1.0], 0, "", "", ""), (120, [], 0, "", "", ""), (140, [1.0], 0, "", "", "")]
    got = answers(ann.search(spark.createDataFrame([*good, (0, [1.0, 0.0], 0, "", "", ""), *bad], SCHEMA)))
    assert got == {0: [(5, 5.0), (4, 4.0), (3, 3.0), (2, 2.0), (1, 1.0)]}
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame([(0, [1.0], 0, "", "", "")], SCHEMA)).count() == 0


def test_every_query_finds_k_where_there_are_k(spark):
    """Tight clusters: the asked parts alone hold too few vectors for some queries."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16)) * 3
    x = (centres[rng.integers(0, 12, 300)] + 0.01 * rng.standard_normal((300, 16))).astype(np.float32).astype(np.float64)
    ids = np.arange(300)
    got = answers(ann.search(frame(spark, ids, x), every=1))
    assert len(got) == 300 and {len(v) for v in got.values()} == {20}
    few = answers(ann.search(frame(spark, ids[:15], x[:15]), every=1))
    assert {len(v) for v in few.values()} == {14}


def test_blocks_of_queries_give_the_same_answers(spark):
    """A part that holds most rows and queries runs in blocks of both; nothing is found twice."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 8))
    x[:300] = x[0] + 0.001 * rng.standard_normal((300, 8))
    x = x.astype(np.float32).astype(np.float64)
    df = frame(spark, np.arange(500), x)
    whole, blocks = answers(ann.search(df, every=1)), answers(ann.search(df, every=1, block_rows=50, query_rows=30))
    assert whole == blocks
