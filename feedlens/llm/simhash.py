"""SimHash near-duplicates through vantage-point trees.

Fingerprints: whole texts, A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``SHINGLE`` words with repeats (fewer words: the whole sequence; none: fingerprint zero);
XXH64 (seed 42) of each; a bit is set if more than half of the hashes set it.

Search: distinct fingerprints only. A vantage-point tree over a bounded sample gives the
shards: a node has a vantage point and a radius, what lies within goes one way, the rest
the other. Each fingerprint has one home shard; by the triangle inequality a pair at
distance r or less can only be split at a node where one of the two lies within r beyond
the radius, so the outer one also visits the inner branch (and a visitor follows every
branch that its bounds leave open). In each shard the same recursion goes on and ends in
leaves that are compared outright. Shards that stay large because their fingerprints lie
close together are dealt to several tasks: homes to all, askers to one each.

A shard reports, not its pairs, but the links of a spanning star per local component: no
connection is lost and a dense group gives no more links than it has members.

Null text has no words. Rows that share text share the fingerprint. A very long text is hashed
whole, one text at a time in its task. Empty tables give no rows. Extra columns are never read (the stage keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import arrow_map, components, extended, fingerprint_col, local_labels, texts_of, unused

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SHARD_ROWS = 2048        # fingerprints per shard aimed at
MAX_SHARDS = 4096        # bounds the tree held by the driver
SAMPLE_PER_SHARD = 32
LEAF_ROWS = 512          # inside a shard
TASK_ROWS = 200_000      # a shard with more rows is dealt to several tasks
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of one UTF-8 text as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    stops = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = range(at, min(n, at + CHUNK))
        h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[part].tolist(), stops[part].tolist())),
                        dtype="<u8", count=len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, into: str, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and the fingerprint as a signed 64-bit column."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in texts_of(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*batch.schema.names, into])
    return arrow_map(docs, run, extended(docs.schema, **{into: "long"}))


# --- the tree --------------------------------------------------------------------------

def far(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def split(points: np.ndarray, r: int, rng) -> tuple | None:
    """(vantage, radius) halving the points, or None if the bounds would leave hardly any
    point on one side only. Of a few vantage points, that with the least overlap."""
    best = None
    for v in points[rng.integers(0, len(points), 4)]:
        d = far(points, v)
        radius = int(np.median(d))
        if (d > radius).all() or (d <= radius).all():
            radius -= 1
        inside, both = int((d <= radius).sum()), int(((d > radius) & (d <= radius + r)).sum())
        if 0 < inside < len(points):
            cost = max(inside + both, len(points) - inside)
            if best is None or cost < best[0]:
                best = (cost, v, radius)
    return None if best is None or best[0] > 0.9 * len(points) else best[1:]


def grow(points: np.ndarray, leaf: int, r: int, rng, next_id: list[int]):
    """Nested (vantage, radius, inner, outer); a leaf is the number of its shard."""
    cut = split(points, r, rng) if len(points) > leaf else None
    if cut is None:
        next_id[0] += 1
        return next_id[0] - 1
    d = far(points, cut[0])
    return (*cut, grow(points[d <= cut[1]], leaf, r, rng, next_id), grow(points[d > cut[1]], leaf, r, rng, next_id))


def route(tree, points: np.ndarray, home: np.ndarray, r: int, out: list) -> None:
    """Appends (shard, points, home) for the shards that the points live in or must visit."""
    if not len(points):
        return
    if not isinstance(tree, tuple):
        out.append((tree, points, home))
        return
    vantage, radius, inner, outer = tree
    d = far(points, vantage)
    # A home inside needn't ask outside: the outer partner asks here.
    to_in, to_out = d <= radius + r, (d > radius) | (~home & (d > radius - r))
    route(inner, points[to_in], home[to_in] & (d[to_in] <= radius), r, out)
    route(outer, points[to_out], home[to_out], r, out)


def near(home: np.ndarray, ask: np.ndarray, r: int, rng, found: list, ids: tuple[np.ndarray, np.ndarray]) -> None:
    """Appends index pairs (home, ask) at distance r or less, through a local tree."""
    if not len(home) or not len(ask):
        return
    cut = split(home, r, rng) if len(home) > LEAF_ROWS else None
    if cut is None:
        step = max(1, (1 << 22) // len(home))
        for at in range(0, len(ask), step):
            i, j = np.nonzero(np.bitwise_count(ask[at:at + step, None] ^ home[None, :]) <= r)
            if len(i):
                found.append(np.stack([ids[0][j], ids[1][i + at]]))
                if sum(x.shape[1] for x in found) > 1 << 20:
                    found[:] = [_star(np.concatenate(found, axis=1))]
        return
    vantage, radius = cut
    dh, da = far(home, vantage), far(ask, vantage)
    for h, a in ((dh <= radius, da <= radius + r), (dh > radius, da > radius - r)):
        near(home[h], ask[a], r, rng, found, (ids[0][h], ids[1][a]))


def _star(pairs: np.ndarray) -> np.ndarray:
    """The same connections with one link per index but the smallest of each component."""
    seen, flat = np.unique(pairs, return_inverse=True)
    a, b = flat.reshape(pairs.shape)
    lab = local_labels(len(seen), a, b)
    own = np.flatnonzero(lab != np.arange(len(seen)))
    return np.stack([seen[lab[own]], seen[own]])


def shard_links(points: np.ndarray, home: np.ndarray, ask: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among the points: homes are compared with askers."""
    at, found = np.arange(len(points)), []
    near(points[home], points[ask], r, np.random.default_rng(7), found, (at[home], at[ask]))
    if not found:
        return points[:0], points[:0]
    pairs = _star(np.concatenate(found, axis=1))
    return points[pairs[0]], points[pairs[1]]


# --- on Spark --------------------------------------------------------------------------

def links(fps: DataFrame, r: int = MAX_BITS, shard_rows: int = SHARD_ROWS, task_rows: int = TASK_ROWS) -> DataFrame:
    """(a, b): star links that connect distinct fingerprints (column ``fp``) at r or fewer
    differing bits."""
    n = fps.count()
    shards = min(MAX_SHARDS, max(1, n // shard_rows))
    sample = np.zeros(0, dtype=np.uint64)
    if shards > 1:
        want = shards * SAMPLE_PER_SHARD
        part = fps.where(F.pmod(F.xxhash64("fp", F.lit("vp")), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, 1.2 * want / n)) + 1))
        sample = np.sort(np.array([x[0] for x in part.limit(2 * want).collect()], dtype=np.int64)).view(np.uint64)
    tree = grow(sample, SAMPLE_PER_SHARD, r, np.random.default_rng(11), [0])

    def visits(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            out: list = []
            route(tree, points, np.ones(len(points), dtype=bool), r, out)
            for shard, p, h in out:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), shard, dtype=np.int32)),
                                                  pa.array(p.view(np.int64)), pa.array(h)], ["shard", "fp", "home"])

    spread = max(shards, fps.sparkSession.sparkContext.defaultParallelism)
    placed = cut_lineage(fps.select("fp").mapInArrow(visits, "shard int, fp long, home boolean"))
    large = {x["shard"]: -(-x["n"] // task_rows) for x in placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
             .where(F.col("n") > task_rows).collect()}  # at most MAX_SHARDS rows
    salts = F.lit(1)
    if large:
        salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in large.items() for x in kv]), F.col("shard")), F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")
    dealt = (placed.withColumn("salts", salts).withColumn("own", own)
             .withColumn("salt", F.explode(F.when(F.col("home") & (F.col("salts") > 1), F.sequence(F.lit(0), F.col("salts") - 1))
                                           .otherwise(F.array("own"))))
             .withColumn("ask", F.col("salt") == F.col("own")).select("shard", "salt", "fp", "home", "ask"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        a, b = shard_links(points, pdf["home"].to_numpy(bool), pdf["ask"].to_numpy(bool), r)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.repartition(spread, "shard", "salt").groupBy("shard", "salt").applyInPandas(search, "a long, b long")


def grouped(rows: DataFrame, r: int = MAX_BITS) -> DataFrame:
    """``rows`` (doc_id, fp) -> (fp, root, first): for every distinct fingerprint its
    component's smallest fingerprint and smallest doc_id. ``rows`` should be checkpointed."""
    own = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut_lineage(components(links(own.select("fp"), r)))
    named = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    linked = cut_lineage(named)
    firsts = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("first")))    # a plain join: hubs are split
    return linked.join(firsts, "root").select("fp", "root", "first")


def near_duplicates(docs: DataFrame, r: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over
    links of r or fewer differing bits). One row per input row."""
    rows = cut_lineage(add_fingerprint(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"))
    groups = grouped(rows, r)
    return rows.join(groups, "fp").select("doc_id", fingerprint_col("fp").alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, r: int = MAX_BITS, shingle: int = SHINGLE) -> DataFrame:
    """The documents of ``docs``, one of each component: that with the smallest doc_id
    (null ids only where a component has no other; of rows that share it, one)."""
    fp, own, last = unused(docs.columns, "__fp", "__own", "__last")
    rows = cut_lineage(add_fingerprint(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"))
    kept = (rows.join(grouped(rows, r), "fp").where(F.col("doc_id").eqNullSafe(F.col("first")))
            .groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x"))
            .select(F.col("x.doc_id").alias(own), F.col("x.fp").alias(last)).distinct())
    held = add_fingerprint(docs, fp, shingle)
    got = held.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(fp) == F.col(last)))
    return got.dropDuplicates([own, last]).select(*docs.columns)
