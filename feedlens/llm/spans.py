"""Substring dedup by De Bruijn compaction of token k-mers.

A document's words (``[^\\x20\\x09-\\x0D]+``, unchanged) are a walk through a graph whose edges
are its windows of ``WINDOW`` words. The windows that repeat are found first; paths of them
that never branch are then compacted into unitigs, and a unitig's occurrences are the spans.

* Edges. Of the k-mers of ``K`` words in a window the one with the least hash (leftmost of
  equals) is the window's vertex; it depends on the window's words only. Consecutive windows
  that share a vertex occurrence travel as one row, a strand: vertex, a digest of its words
  and the digest of the strand after it. About one word in thirteen starts a strand.
* Counts. A vertex that occurs once leaves the graph. A vertex whose strands are all equal
  doesn't branch. At a branching vertex one representative of each distinct strand is read
  again at its source coordinates, and its windows are counted one by one, each with what
  follows it (digests of the exact words, together with the vertex: 128 bits).
* Runs. Windows of a strand join while each is always followed by the next and the next is
  always preceded by it (equal counts of both and of the pair).
* Unitigs. The run that ends a strand joins the run that starts the strand behind it under the same
  condition. Chains of such links compact by pointer jumping: a self-join per round doubles how far a
  run sees, so rounds grow with the logarithm of the longest repeated passage. (A
  text is finite, so a chain can't be a ring: its first run has nothing before it.)
* Coordinates. One occurrence of each unitig is read at its source; every other occurrence
  is compared with its 128-bit digest before its words go.

What is joined and counted is one row per strand, not per window, and a passage that
very many documents share is one chain of strands with counts.

Defined cases: null text has no words; a text shorter than a window repeats nothing; rows
that share doc_id are documents of their own (a row's identity is its doc_id and text, and
equal rows repeat each other, so both lose their repeated words); a very long text is cut into
words whole, one text at a time in its task; empty tables give no rows; further columns are kept by ``remove_repeats`` and never read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import arrow_map, discard, mix64, staged, texts_of, unused

WINDOW = 35   # words in a span that must not repeat
K = 10        # words in a k-mer
MULT = np.uint64(0x9E3779B97F4A7C15)  # odd: has an inverse modulo 2^64
INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))


class Powers:
    """MULT^i and its inverse, as far as the longest text so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            ones = np.ones(n, dtype=np.uint64)
            self.up = np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * MULT]))
            self.down = np.multiply.accumulate(np.concatenate([ones[:1], ones[1:] * INVERSE]))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


class Words:
    """The words of a text joined by one space, with where each starts and ends."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        self.joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=self.n)
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths

    def hashes(self, k: int) -> np.ndarray:
        """Hash of each run of k words."""
        data = np.frombuffer(self.joined, dtype=np.uint8)
        up, down = _POWERS.to(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data] * up[:len(data)], out=total[1:])
        s, e = self.starts[:self.n - k + 1], self.ends[k - 1:]
        return mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))

    def slice(self, first: int, n: int) -> bytes:
        return self.joined[self.starts[first]:self.ends[first + n - 1]]


def strands_of(w: Words, window: int, k: int) -> tuple[np.ndarray, ...]:
    """(vertex hash, vertex place, first window, last window) of a document's strands."""
    if w.n < window:
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    h = w.hashes(k)
    at = np.arange(w.n - window + 1) + sliding_window_view(h, window - k + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return h[at[first]], at[first], first, last


def identity(text="text") -> tuple[F.Column, F.Column]:
    """What identifies a row: its doc_id (without one, a hash of its text) and a check of its
    text, which tells rows apart that share a doc_id."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(t)), F.hash(t)


def keyed(docs: DataFrame) -> DataFrame:
    """id, check, text of each row."""
    row_id, check = identity()
    return docs.select(row_id.alias("id"), check.alias("check"), F.coalesce("text", F.lit("")).alias("text"))


def strands(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """id, check, vertex, words (digest), after (digest of the next strand, null for a text's
    last), spot: first window << 16 | windows - 1 << 8 | place of the vertex in the first window."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        which, ends, cols = [], [], ([], [], [], [])
        for i, text in enumerate(texts_of(batch)):
            w = Words(text)
            vertex, at, first, last = strands_of(w, window, k)
            if not len(at):
                continue
            s, e = w.starts[first].tolist(), w.ends[last + window - 1].tolist()
            digest = np.fromiter((xxhash.xxh3_64_intdigest(w.joined[a:b]) for a, b in zip(s, e)), dtype=np.uint64, count=len(s))
            which.append(np.full(len(at), i))
            ends.append(np.arange(len(at)) == len(at) - 1)
            for col, x in zip(cols, (vertex, digest, np.roll(digest, -1), first << 16 | (last - first) << 8 | (at - first))):
                col.append(x.view(np.int64))
        if not which:
            return None
        row = pa.array(np.concatenate(which))
        vertex, words, after, spot = (np.concatenate(c) for c in cols)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(vertex), pa.array(words),
                                           pa.array(after, mask=np.concatenate(ends)), pa.array(spot)],
                                          ["id", "check", "vertex", "words", "after", "spot"])
    return arrow_map(keyed(docs), run, "id long, check int, vertex long, words long, after long, spot long")


def _first(spot: str):
    return F.shiftright(F.col(spot), 16)


def _read_windows(docs: DataFrame, classes: DataFrame, window: int) -> DataFrame:
    """Windows of one occurrence of each distinct strand: vertex, words, n, bit (place in the
    strand), digest, next (digest of the window behind it in the strand)."""
    asked = (classes.select("at.id", "at.check", F.struct("vertex", "words", "n", "at.spot").alias("e"))
             .groupBy("id", "check").agg(F.collect_list("e").alias("strands")))

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        vertex, words, n, bit, digest, behind = [], [], [], [], [], []
        for text, wanted in zip(texts_of(batch), batch.column(1).to_pylist()):
            w = Words(text)
            for e in wanted:
                start, more = e["spot"] >> 16, e["spot"] >> 8 & 255
                seen = [xxhash.xxh3_64_intdigest(w.slice(start + i, window), seed=1) for i in range(more + 1)]
                vertex += [e["vertex"]] * len(seen)
                words += [e["words"]] * len(seen)
                n += [e["n"]] * len(seen)
                bit += range(more + 1)
                digest += seen
                behind += [*seen[1:], 0]
        if not vertex:
            return None
        digest, behind = (np.array(x, dtype=np.uint64).view(np.int64) for x in (digest, behind))
        last = np.append(np.array(bit[1:]) == 0, True)
        return pa.RecordBatch.from_arrays(
            [pa.array(vertex, pa.int64()), pa.array(words, pa.int64()), pa.array(n, pa.int64()), pa.array(bit, pa.int32()),
             pa.array(digest), pa.array(behind, mask=last)], ["vertex", "words", "n", "bit", "digest", "next"])
    # Equal rows hold the same windows: one of them is read, so that counts stay exact.
    texts = keyed(docs).dropDuplicates(["id", "check"]).join(asked, ["id", "check"])
    return arrow_map(texts.select("text", "strands"), look_up,
                     "vertex long, words long, n long, bit int, digest long, next long")


def _runs(found: DataFrame, keep) -> DataFrame:
    """Repeated windows of branching vertices, joined while the path doesn't branch: vertex,
    words, sig (digest of the first window), bit, len (windows), n, front, tail."""
    seen = keep(found.groupBy("vertex", "digest").agg(
        F.sum("n").alias("total"), F.min("next").alias("lo"), F.max("next").alias("hi"),
        F.max(F.col("next").isNull()).alias("ends")).where("total > 1")
        .select("vertex", "digest", "total", F.when(~F.col("ends") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("only")), "seen")
    order = Window.partitionBy("vertex", "words").orderBy("bit")  # at most WINDOW - K + 1 rows
    joins = ((F.lag("bit").over(order) == F.col("bit") - 1) & (F.lag("only").over(order) == F.col("digest"))
             & (F.lag("total").over(order) == F.col("total")))
    marked = found.join(seen, ["vertex", "digest"]).withColumn("start", ~F.coalesce(joins, F.lit(False)))
    numbered = marked.withColumn("run", F.sum(F.col("start").cast("int")).over(order))
    return (numbered.groupBy("vertex", "words", "run")
            .agg(F.max(F.when(F.col("start"), F.col("digest"))).alias("sig"), F.min("bit").alias("bit"),
                 F.count(F.lit(1)).alias("len"), F.max("total").alias("n"), F.max(F.col("next").isNull()).alias("tail"))
            .select("vertex", "words", "sig", "bit", "len", "n", (F.col("bit") == 0).alias("front"), "tail"))


def _links(held: DataFrame, runs: DataFrame, keep) -> DataFrame:
    """x, y: run y always follows run x, and x always precedes y; with the windows of both."""
    node = F.struct("vertex", "sig")
    tails = runs.where("tail").select("vertex", "words", node.alias("x"), F.col("n").alias("nx"), F.col("len").alias("len_x"))
    # The next strand is named by 64 bits; a name that two held strands share links nothing.
    fronts = (runs.where("front").groupBy("words").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("vertex", "sig")).alias("y"),
                                                       F.max("n").alias("ny"), F.max("len").alias("len_y"))
              .where("c = 1").select(F.col("words").alias("after"), "y", "ny", "len_y"))
    pairs = held.where("after IS NOT NULL").groupBy("vertex", "words", "after").agg(F.count(F.lit(1)).alias("m"))
    both = pairs.join(tails, ["vertex", "words"]).join(keep(fronts, "fronts"), "after").where("nx = ny")
    return (both.groupBy("x", "y", "len_x", "len_y", "nx").agg(F.sum("m").alias("m")).where("m = nx")
            .select("x", "y", "len_x", "len_y"))


def compact(links: DataFrame) -> DataFrame:
    """node, head, at (windows from the head's first to the node's first), len: every run that
    has one before it, with the first run of its path, by pointer jumping. Rows whose pointer
    is at a path's start (``done``) are never looked up again, and the others point
    to different runs each, so no key of a round's join is hot however long a path is."""
    links = cut_lineage(links.select(F.col("y").alias("node"), F.col("x").alias("head"), F.col("len_x").alias("at"), F.col("len_y").alias("len")))
    inner = links.select(F.col("node").alias("head"), F.lit(False).alias("known"))
    far = cut_lineage(links.join(inner, "head", "left").select("node", "head", "at", "len", F.col("known").isNull().alias("done")))
    while far.agg(F.max(~F.col("done"))).first()[0]:
        up = far.select(F.col("node").alias("head"), F.col("head").alias("top"), F.col("at").alias("more"), F.col("done").alias("ends"))
        step = far.where(~F.col("done")).join(up, "head").select(
            "node", F.col("top").alias("head"), (F.col("at") + F.col("more")).alias("at"), "len", F.col("ends").alias("done"))
        far = cut_lineage(far.where("done").unionByName(step))
    return far.drop("done")


def _verified(docs: DataFrame, unitigs: DataFrame, window: int) -> DataFrame:
    """vertex, sig, sha: digest of the words of one occurrence of each unitig, at its source."""
    asked = (unitigs.groupBy("vertex", "sig").agg(F.min(F.struct("id", "check", "first", "windows")).alias("at"))
             .groupBy("at.id", "at.check").agg(F.collect_list(F.struct("vertex", "sig", "at.first", "at.windows")).alias("spans")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = ([], [], [])
        for text, spans in zip(texts_of(batch), batch.column(1).to_pylist()):
            w = Words(text)
            for s in spans:
                for col, x in zip(out, (s["vertex"], s["sig"], xxhash.xxh3_128_digest(w.slice(s["first"], s["windows"] + window - 1)))):
                    col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                                          ["vertex", "sig", "sha"])
    texts = keyed(docs).dropDuplicates(["id", "check"]).join(asked, ["id", "check"])
    return arrow_map(texts.select("text", "spans"), run, "vertex long, sig long, sha binary")


def unitig_spans(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """id, check, first, windows, sha: every occurrence of every unitig of repeated windows;
    ``sha`` is the digest of the words at the unitig's own source."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark)}/unitigs-{uuid.uuid4().hex}"

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    every = keep(strands(docs, window, k), "strands")
    # What a hot key is joined with is staged first: then both sides are plain shuffles, and
    # Spark can split the hot one.
    vertices = keep(every.groupBy("vertex").agg(F.count(F.lit(1)).alias("n"), F.min("words").alias("lo"), F.max("words").alias("hi"))
                    .where("n > 1").select("vertex", (F.col("lo") != F.col("hi")).alias("branching")), "vertices")
    held = keep(every.join(vertices, "vertex"), "held")
    discard(spark, f"{folder}/strands")
    classes = keep(held.groupBy("vertex", "words", "branching")
                   .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "check", "spot")).alias("at")), "classes")
    found = keep(_read_windows(docs, classes.where("branching"), window), "windows")
    straight = classes.where(~F.col("branching")).select(
        "vertex", "words", F.col("words").alias("sig"), F.lit(0).alias("bit"),
        (F.expr("shiftright(at.spot, 8) & 255") + 1).alias("len"), "n", F.lit(True).alias("front"), F.lit(True).alias("tail"))
    runs = keep(straight.unionByName(_runs(found, keep)), "runs")
    paths = compact(_links(held, runs, keep))
    node = F.struct("vertex", "sig")
    long = paths.groupBy("head").agg(F.max(F.col("at") + F.col("len")).alias("total")).withColumnRenamed("head", "node")
    heads = (runs.withColumn("node", node).join(paths.select("node"), "node", "left_anti")
             .join(long, "node", "left").select("vertex", "words", "sig", "bit", F.coalesce("total", "len").alias("windows")))
    heads = keep(heads, "heads")
    placed = heads.join(classes, ["vertex", "words"]).select(
        "vertex", "sig", "windows", "at.id", "at.check", (_first("at.spot") + F.col("bit")).alias("first"))
    sha = keep(_verified(docs, placed, window), "sha")
    starts = keep(heads.join(sha, ["vertex", "sig"]).groupBy("vertex", "words")
                  .agg(F.collect_list(F.struct("bit", "windows", "sha")).alias("spans")), "starts")
    spans = (held.join(starts, ["vertex", "words"])
             .select("id", "check", "spot", F.explode("spans").alias("s"))
             .select("id", "check", (_first("spot") + F.col("s.bit")).alias("first"), "s.windows", "s.sha"))
    spans = staged(spans, "spans")
    discard(spark, folder)
    return spans


def covered(w: Words, spans: list, window: int) -> np.ndarray:
    """Which words lie in a span whose words are those at the unitig's source."""
    step = np.zeros(w.n + 1, dtype=np.int64)
    for s in spans:
        first, n = s["first"], s["windows"] + window - 1
        if xxhash.xxh3_128_digest(w.slice(first, n)) == s["sha"]:
            step[first] += 1
            step[first + n] -= 1
    return np.cumsum(step[:w.n]) > 0


def _with_spans(docs: DataFrame, window: int, k: int) -> DataFrame:
    """``docs`` and, as last column, the repeated spans of each row."""
    row_id, check, own_id, own_check, found = unused(docs.columns, "__id", "__check", "__own", "__text", "__spans")
    spans = (unitig_spans(docs, window, k).groupBy("id", "check")
             .agg(F.collect_set(F.struct("first", "windows", "sha")).alias(found))
             .select(F.col("id").alias(row_id), F.col("check").alias(check), found))
    a, b = identity()
    on = (F.col(own_id) == F.col(row_id)) & (F.col(own_check) == F.col(check))
    return docs.withColumns({own_id: a, own_check: b}).join(spans, on, "left").select(*docs.columns, found)


def _kept(text: bytes, spans, window: int) -> tuple[int, list[bytes]]:
    words = text.split()
    if not spans:
        return len(words), words
    gone = covered(Words(text), spans, window)
    return len(words), [w for w, g in zip(words, gone) if not g]


def dedup_report(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, gone, sha = [], [], []
        for text, spans in zip(texts_of(batch), batch.column(2).to_pylist()):
            total, kept = _kept(text, spans, window)
            n.append(total), gone.append(total - len(kept)), sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
                                          ["doc_id", "n_words", "n_removed", "kept_sha256"])
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(_with_spans(d, window, k), run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` without the words of repeated spans. A text that loses words has its kept
    words joined by one space; the others stay as they are. Columns as in ``docs``."""
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = []
        for raw, text, spans in zip(batch.column(at).to_pylist(), texts_of(batch), batch.column(len(names)).to_pylist()):
            new.append(b" ".join(_kept(text, spans, window)[1]).decode() if spans else raw)
        cols = list(batch.columns[:len(names)])
        cols[at] = pa.array(new, pa.string())
        return pa.RecordBatch.from_arrays(cols, names)
    return arrow_map(_with_spans(docs, window, k), run, docs.schema)


ORACLE = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT r, i, md5(array_to_string(ws[i : i + 34], ' ')) AS h FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
d AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
c AS (SELECT r, list(DISTINCT p) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM x SEMI JOIN d ON x.h = d.h) GROUP BY r),
k AS (SELECT doc_id, ws, coalesce(len(gone), 0) AS n,
  CASE WHEN gone IS NULL THEN ws ELSE list_filter(ws, lambda e, i: NOT list_contains(gone, i)) END AS kept FROM w LEFT JOIN c ON w.r = c.r)
SELECT doc_id, len(ws)::BIGINT AS n_words, n::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
