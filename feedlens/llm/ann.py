"""Approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (``SAMPLE`` rows by hash of the id): the k-nearest-neighbour graph
of the sample is cut into balanced parts, first by halving along the direction of largest
spread, then by moving vertices to the part most of their neighbours are in while it has
room. A softmax classifier learns for each sample vector which parts hold it and its
neighbours. The number of parts a query asks is the least that reaches ``TARGET`` recall on
sample queries; it is raised, never the candidates cut. A query whose parts together hold
fewer than k + 1 vectors asks further parts until they do, so it finds k where there are k.

Index: every vector goes to its most probable part. A part with more than ``BLOCK_ROWS``
vectors (copies of one vector, say) is dealt to several blocks, and so are the queries that
ask a part; every block of queries meets every block of the part, both of bounded size, and
answers with its best exact inner products.

Vectors that are null, zero, hold null or non-finite components, or have another length
than most take no part, as queries or candidates. Equal scores go to the smaller vec_id;
scores are double precision sums over the original vectors, the same for equal vectors
wherever they are compared. Rows that share a vec_id are candidates each (a query never
meets a row with its own vec_id). Null ids take no part. Fewer candidates than asked for:
all of them. Empty tables give no rows, extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SAMPLE = 8192
NEIGHBOURS = 20
ROWS_PER_PART = 4096
MIN_PARTS, MAX_PARTS = 32, 1024
BLOCK_ROWS = 8192
QUERY_ROWS = 8192
TARGET = 0.97     # recall on the sample that the number of asked parts must reach
GRAPH_K = 16


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>): the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = (F.col("vec_id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False))
            & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("v", lambda x: x != 0.0), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(fine)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (usual["n"] if usual else 0))


# --- the index, fitted on a sample ------------------------------------------------------

def knn(x: np.ndarray, q: np.ndarray, k: int, own: np.ndarray | None = None, step: int = 512) -> np.ndarray:
    """Rows of x with the largest inner products with each q (own: the row not to return)."""
    out = np.empty((len(q), k), dtype=np.int64)
    for at in range(0, len(q), step):
        s = q[at:at + step] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[at:at + step]] = -np.inf
        out[at:at + step] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def halve(x: np.ndarray, parts: int, rng) -> np.ndarray:
    """Balanced start: parts of equal size by recursive halving."""
    label = np.zeros(len(x), dtype=np.int64)

    def go(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1 or not len(rows):
            label[rows] = first
            return
        centred = x[rows] - x[rows].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):
            d = centred.T @ (centred @ d)
            d /= np.linalg.norm(d) + 1e-30
        order = rows[np.argsort(centred @ d, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        go(order[:cut], first, left)
        go(order[cut:], first + left, n - left)

    go(np.arange(len(x)), 0, parts)
    return label


def refine(label: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.1) -> np.ndarray:
    """Moves vertices to the part that holds most of their neighbours, while it has room."""
    room = int(np.ceil(len(label) / parts * slack))
    size = np.bincount(label, minlength=parts)
    label = label.copy()
    for _ in range(rounds):
        votes = np.zeros((len(label), parts), dtype=np.int16)
        np.add.at(votes, (np.arange(len(label))[:, None], label[graph]), 1)
        best = votes.argmax(axis=1)
        at = np.arange(len(label))
        gain = votes[at, best] - votes[at, label]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if moved < len(label) // 200:
            break
    return label


def learn(x: np.ndarray, target: np.ndarray, steps: int = 200, rate: float = 0.05) -> np.ndarray:
    """Softmax weights (components + 1, parts) for soft targets, by Adam on all rows."""
    xb = np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1]), np.ones((len(x), 1))], axis=1)
    w = np.zeros((xb.shape[1], target.shape[1]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = xb @ w
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        g = xb.T @ (p - target) / len(x) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w


def logits(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True) * np.sqrt(x.shape[1]) @ w[:-1] + w[-1]


def fit(x: np.ndarray, parts: int, k: int = NEIGHBOURS, target: float = TARGET) -> tuple[np.ndarray, int]:
    """(classifier, parts to ask) from sample vectors."""
    rng = np.random.default_rng(5)
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return np.zeros((x.shape[1] + 1, 1)), 1
    graph = knn(x, x, min(GRAPH_K, len(x) - 1), np.arange(len(x)))
    label = refine(halve(x, parts, rng), graph, parts)
    soft = np.zeros((len(x), parts))
    np.add.at(soft, (np.arange(len(x))[:, None], label[graph]), 0.5 / graph.shape[1])
    soft[np.arange(len(x)), label] += 0.5
    w = learn(x, soft)
    z = logits(w, x)
    home = z.argmax(axis=1)
    asked = rng.choice(len(x), min(1024, len(x)), replace=False)
    true = knn(x, x[asked], min(k, len(x) - 1), asked)
    rank = np.argsort(np.argsort(-z[asked], axis=1), axis=1)  # place of each part for each query
    needed = np.sort(np.take_along_axis(rank, home[true], axis=1).ravel())
    return w, int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1


# --- on Spark --------------------------------------------------------------------------

def search(vectors: DataFrame, k: int = NEIGHBOURS, every: int = 20, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible
    by ``every``, nearest first."""
    spark = vectors.sparkSession
    rows = cut_lineage(valid(vectors))
    n = rows.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], empty)
    share = min(1.0, 1.1 * sample / n)
    some = (rows.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
            .limit(2 * sample).collect())
    x = np.array([r["v"] for r in sorted(some, key=lambda r: r["vec_id"])[:sample]])
    parts = min(MAX_PARTS, max(MIN_PARTS, n // ROWS_PER_PART))
    w, ask = fit(x, parts, k) if len(x) else (np.zeros((len(rows.first()["v"]) + 1, 1)), 1)

    def route(pdfs):
        for pdf in pdfs:
            if not len(pdf):
                continue
            z = logits(w, np.stack(pdf["v"].to_numpy()))
            query = (pdf["vec_id"] % every == 0).to_numpy()
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "part": z.argmax(axis=1).astype(np.int32), "query": query})

    routed = cut_lineage(rows.mapInPandas(route, "vec_id long, v array<double>, part int, query boolean"))
    counts = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}  # MAX_PARTS rows at most
    held_by = np.array([counts.get(p, 0) for p in range(w.shape[1])])

    def ask_parts(pdfs):
        """The parts that each query asks: the ``ask`` most probable ones, and on to k + 1 vectors."""
        for pdf in pdfs:
            if len(pdf):
                order = np.argsort(-logits(w, np.stack(pdf["v"].to_numpy())), axis=1, kind="stable").astype(np.int32)
                enough = (np.cumsum(held_by[order], axis=1) < k + 1).sum(axis=1) + 1
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "v": pdf["v"], "asks": [o[:max(ask, m)].tolist() for o, m in zip(order, enough)]})

    queries = routed.where("query").select("vec_id", "v").mapInPandas(ask_parts, "vec_id long, v array<double>, asks array<int>")
    queries = cut_lineage(queries.select("vec_id", "v", F.explode("asks").alias("part")))
    asking = {r["part"]: r["count"] for r in queries.groupBy("part").count().collect()}

    def dealt(sizes: dict[int, int], rows: int):
        """Blocks of a part, from the rows of each part."""
        return F.create_map(*[F.lit(x) for p in sorted(counts) for x in (p, max(1, -(-sizes.get(p, 0) // rows)))])[F.col("part")]

    def own_block(n):
        return F.pmod(F.xxhash64("vec_id"), n).cast("int")

    def every_block(n):
        return F.explode(F.sequence(F.lit(0), n - 1))

    blocks, turns = dealt(counts, block_rows), dealt(asking, query_rows)
    held = (routed.select("vec_id", "v", "part", own_block(blocks).alias("block"))
            .select("vec_id", "v", "part", "block", every_block(turns).alias("turn")))
    asked = (queries.where(F.col("part").isin(sorted(counts))).select("vec_id", "v", "part", own_block(turns).alias("turn"))
             .select("vec_id", "v", "part", "turn", every_block(blocks).alias("block")))

    def answer(cands: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(cands) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        cands = cands.sort_values("vec_id", kind="stable")
        c, ids = np.stack(cands["v"].to_numpy()), cands["vec_id"].to_numpy()
        q_all, q_ids = np.stack(queries["v"].to_numpy()), queries["vec_id"].to_numpy()
        out = []
        for at in range(0, len(q_ids), 256):
            s = q_all[at:at + 256] @ c.T
            s[q_ids[at:at + 256, None] == ids[None, :]] = -np.inf
            top = min(k, len(ids))
            least = -np.partition(-s, top - 1, axis=1)[:, top - 1]
            # within rounding of the k-th: ties must be settled by exact scores and ids
            slack = 1e-9 * np.maximum(1.0, np.abs(s).max(axis=1, initial=0.0, where=np.isfinite(s)))
            qi, ci = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
            exact = (q_all[at + qi] * c[ci]).sum(axis=1)
            order = np.lexsort((ids[ci], -exact, qi))
            qi, ci, exact = qi[order], ci[order], exact[order]
            first = np.searchsorted(qi, qi)
            keep = np.arange(len(qi)) - first < k
            out.append(pd.DataFrame({"query_id": q_ids[at + qi[keep]], "vec_id": ids[ci[keep]], "score": exact[keep]}))
        return pd.concat(out)

    group = ["part", "block", "turn"]
    found = (held.groupBy(*group).cogroup(asked.groupBy(*group))
             .applyInPandas(answer, "query_id long, vec_id long, score double"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
