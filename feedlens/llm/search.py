"""Ranked lexical search by dual trees: the k best documents of every item, exactly.

1. Items are dealt by hash into blocks of about ``ITEM_TERMS`` (item, term) pairs; the block is
   what a task holds of the query side. The rest runs once per block.
2. One pass over the texts keeps, per document, its length and the block's terms in it. Sums
   over these rows give the document frequencies, and so weights and impacts (the factor of a
   term's weight in a document's score).
3. Documents are dealt by ranges of their two heaviest terms, so neighbours are alike, and
   packed into batches. A batch has a tree: leaves of ``LEAF`` documents, ``FAN`` of them to a
   node, a root; every node holds, per term, the largest impact below it. The block's items
   have a tree too: every node holds, per term, the largest weight below it.
4. Node pairs are visited from the roots. The sum over terms of weight times impact bounds
   every score below a pair; a pair whose bound is under the weakest k-th best score of its
   items is pruned with all that lies below it. Equal bounds stay, as ties go to the smaller
   doc_id. The first round searches, for each item, the batch with the largest bound of all;
   its k-th scores are where the second round starts, over all other batches.

Nothing is approximate: a bound only ever skips documents that can't be among the k best.
Scores are whole numbers; sums that doubles can't hold exactly are taken in 64-bit integers.

Null or empty texts have no terms: they neither count nor match. Items without terms have no
rows; rows that share an item_id (null too) form one item. Documents that share a doc_id are
ranked each on their own; null doc_ids come last among equals. Very long texts are read whole,
one at a time. Empty tables give no rows. Other columns are never read. One item's terms must
fit a task; the number of items, of documents and of copies is free.
"""

from __future__ import annotations

import functools
import string
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import arrow_map, batch_rows, discard, texts_of

K = 10
ITEM_TERMS = 100_000   # (item, term) pairs of a block, on average
CELLS = 2 ** 21        # documents x terms of a batch
LEAF, FAN, ITEM_FAN = 16, 8, 4
EXACT = 2 ** 53

# A-Z become a-z; every other ASCII character that is no digit or letter ends a term
TERMS = bytes(c + 32 if chr(c) in string.ascii_uppercase else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERMS).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, terms = [], []
        for i, t in zip(b.column(0).to_pylist(), texts_of(b)):
            words = terms_of(t)
            ids += [i] * len(words)
            terms += [w.decode() for w in words]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(terms, pa.string())], names=["item_id", "term"])
    words = arrow_map(items.select(F.col("item_id").cast("long"), "text"), rows, "item_id long, term string")
    return words.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


def read_documents(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms), ids and tfs (the vocabulary's terms in it, int32 each) of every
    document with a term. ``vocabulary``: broadcast dict of the block's terms."""
    def rows(b: pa.RecordBatch) -> pa.RecordBatch:
        number = vocabulary.value.get
        out: list[tuple] = []
        for i, t in zip(b.column(0).to_pylist(), texts_of(b)):
            words = terms_of(t)
            if words:
                ids, tfs = np.unique(np.fromiter(map(number, words, repeat(-1)), np.int32, len(words)), return_counts=True)
                known = int(ids[0] == -1)
                out.append((i, len(words), ids[known:].tobytes(), tfs[known:].astype(np.int32).tobytes()))
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["doc_id", "n", "ids", "tfs"])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), rows, "doc_id long, n long, ids binary, tfs binary")


def corpus_totals(read: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the block's document frequencies; every task sends its sums only."""
    def sums(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size + 2, np.int64)
        for b in batches:
            total[size] += b.num_rows
            total[size + 1] += sum(b.column(0).to_pylist())
            ids = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int32)
            total[:size] += np.bincount(ids, minlength=size)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["term", "amount"])
    got = read.select("n", "ids").mapInArrow(sums, "term long, amount long").groupBy("term").agg(F.sum("amount").alias("amount")).collect()
    total = np.zeros(size + 2, np.int64)
    for r in got:
        total[r["term"]] = r["amount"]
    return int(total[size]), int(total[size + 1]), total[:size]


def impacts(tfs: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The factor of a term's weight in a document's score."""
    m = 100 - 75 + (75 * n * documents) // length
    return (1_000_000_000 * tfs) // (1000 * tfs + 8 * m)


class Items:
    """The tree over a block's items. Level 0 holds the items, the last level one root; a
    node is (terms, largest weights) with its children in ``span``."""

    def __init__(self, rows: list[tuple[object, int, int]], weights: np.ndarray):
        by: dict[object, dict[int, int]] = {}
        for item, term, times in rows:
            by.setdefault(item, {})[term] = times * int(weights[term])

        def heavy(item):
            return sorted(by[item], key=lambda t: (-by[item][t], t))[:2]
        self.ids = sorted(by, key=lambda i: (heavy(i), i is None, i or 0))
        sparse = [(np.array(sorted(by[i]), np.int64), np.array([by[i][t] for t in sorted(by[i])], np.int64)) for i in self.ids]
        self.levels, self.span = [sparse], [[(k, k + 1) for k in range(len(sparse))]]
        while len(self.levels[-1]) > 1:
            low, spans, nodes, of = self.levels[-1], self.span[-1], [], []
            for k in range(0, len(low), ITEM_FAN):
                part = low[k:k + ITEM_FAN]
                terms, at = np.unique(np.concatenate([t for t, _ in part]), return_inverse=True)
                most = np.zeros(len(terms), np.int64)
                np.maximum.at(most, at, np.concatenate([w for _, w in part]))
                nodes.append((terms, most))
                of.append((spans[k][0], spans[min(k + ITEM_FAN, len(low)) - 1][1]))
            self.levels.append(nodes)
            self.span.append(of)
        self.exact = max((int(w.sum()) for _, w in sparse), default=0) * 1_000_000 < EXACT


class Batch:
    """The tree over a batch's documents: ``levels`` from the leaves' maxima to the root's."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, starts: np.ndarray, terms: np.ndarray, impact: np.ndarray, size: int, exact: bool):
        self.ids, self.known = ids, known
        cols, at = np.unique(terms, return_inverse=True)
        self.column = np.full(size, -1, np.int64)
        self.column[cols] = np.arange(len(cols))
        self.docs = np.zeros((len(ids), max(1, len(cols))), np.float32 if exact else np.int64)
        self.docs[np.repeat(np.arange(len(ids)), np.diff(starts)), at] = impact
        self.kind = np.float64 if exact else np.int64
        self.levels, step = [self.docs], LEAF
        while len(self.levels[-1]) > 1 or len(self.levels) == 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), step), axis=0))
            step = FAN

    def sums(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weight times (largest) impact, summed over the terms, of nodes of a level."""
        cols = self.column[terms]
        there = cols >= 0
        got = self.levels[level][np.ix_(nodes, cols[there])].astype(self.kind) @ weights[there].astype(self.kind)
        return got.astype(np.int64)

    def below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The children of nodes."""
        fan = LEAF if level == 1 else FAN
        every = (nodes[:, None] * fan + np.arange(fan)).ravel()
        return every[every < len(self.levels[level - 1])]


class Finder:
    """The k best documents of every item of a block, batch after batch."""

    def __init__(self, items: Items, floor: np.ndarray, k: int):
        self.items, self.k = items, k
        self.floor = floor.copy()          # scores below can't be among the k best
        self.best: list[list[tuple]] = [[] for _ in items.ids]    # (-score, id is null, id)
        self.scored = 0

    def search(self, batch: Batch) -> None:
        if self.items.ids:
            self._visit(batch, len(self.items.levels) - 1, 0, len(batch.levels) - 1, np.zeros(1, np.int64))

    def _visit(self, batch: Batch, level: int, node: int, depth: int, nodes: np.ndarray) -> None:
        lo, hi = self.items.span[level][node]
        terms, weights = self.items.levels[level][node]
        bounds = batch.sums(depth, nodes, terms, weights)
        alive = bounds >= max(1, int(self.floor[lo:hi].min()))
        nodes, bounds = nodes[alive], bounds[alive]
        if not len(nodes):
            return
        if level == 0 and depth == 1:
            self._score(batch, node, nodes, bounds)
            return
        inner = batch.below(depth, nodes) if depth > 1 else nodes
        if level == 0:
            self._visit(batch, 0, node, depth - 1, inner)
            return
        for child in range(node * ITEM_FAN, min(node * ITEM_FAN + ITEM_FAN, len(self.items.levels[level - 1]))):
            self._visit(batch, level - 1, child, max(1, depth - 1), inner)

    def _score(self, batch: Batch, item: int, leaves: np.ndarray, bounds: np.ndarray) -> None:
        """The documents of the leaves that may matter, the most promising leaves first."""
        order = np.argsort(-bounds, kind="stable")
        terms, weights = self.items.levels[0][item]
        for k in range(0, len(order), FAN):
            part = order[k:k + FAN]
            part = part[bounds[part] >= max(1, int(self.floor[item]))]
            if not len(part):
                return
            docs = batch.below(1, leaves[part])
            scores = batch.sums(0, docs, terms, weights)
            self.scored += len(docs)
            good = scores >= max(1, int(self.floor[item]))
            found = [(-s, not batch.known[d], int(batch.ids[d])) for d, s in zip(docs[good].tolist(), scores[good].tolist())]
            if found:
                self.best[item] = sorted(self.best[item] + found)[:self.k]
                if len(self.best[item]) == self.k:
                    self.floor[item] = max(self.floor[item], -self.best[item][-1][0])

    def rows(self) -> pa.RecordBatch:
        out = [(i, self.items.ids[i], None if null else d, -s) for i, best in enumerate(self.best) for s, null, d in best]
        cols = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])


FOUND = "item long, item_id long, doc_id long, score long"
PACKED = "ids binary, known binary, starts binary, terms binary, impact binary, top_terms binary, top_impact binary"


def pack(read: DataFrame, weights, documents: int, length: int, size: int) -> DataFrame:
    """Batches (``PACKED``) of documents with any of the block's terms, neighbours alike."""
    per = min(4096, max(4 * LEAF, CELLS // max(1, size)))

    def keyed(b: pa.RecordBatch) -> pa.RecordBatch:
        weight, keys, made = weights.value, [], []
        rank = np.empty(size, np.int64)
        rank[np.argsort(-weight, kind="stable")] = np.arange(size)
        for n, ids, tfs in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
            t, f = np.frombuffer(ids, np.int32), np.frombuffer(tfs, np.int32).astype(np.int64)
            u = impacts(f, np.int64(n), documents, length)
            made.append(u.astype(np.int32).tobytes())
            first = np.argsort(-(weight[t] * u), kind="stable")[:2]
            a, c = [*rank[t[first]].tolist(), size, size][:2]
            keys.append(a << 32 | c)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), b.column(2), pa.array(made, pa.binary())],
                                          names=["doc_id", "key", "ids", "impact"])

    def batches(parts: Iterator[pa.RecordBatch]):
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            t = np.frombuffer(b"".join(x[1] for x in held), np.int32)
            u = np.frombuffer(b"".join(x[2] for x in held), np.int32)
            starts = np.concatenate([[0], np.cumsum([len(x[1]) // 4 for x in held])]).astype(np.int64)
            most = np.zeros(size, np.int32)
            np.maximum.at(most, t, u)
            top = np.nonzero(most)[0].astype(np.int32)
            row = (np.array([x[0] or 0 for x in held], np.int64), np.array([x[0] is not None for x in held]), starts, t, u, top, most[top])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=[c.split()[0] for c in PACKED.split(", ")])
        for b in parts:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                if len(held) == per:
                    yield out()
        if held:
            yield out()

    rows = arrow_map(read.where(F.length("ids") > 0), keyed, "doc_id long, key long, ids binary, impact binary")
    # equal documents (a hot group of copies too) are told apart by doc_id
    parts = rows.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "ids", "impact")
    return parts.mapInArrow(batches, PACKED).withColumn("batch", F.monotonically_increasing_id())


def promising(packed: DataFrame, items) -> DataFrame:
    """item, batch, bound: for every item and task, the batch with the largest root bound."""
    def rows(parts: Iterator[pa.RecordBatch]):
        own = items.value
        best = [(-1, 0)] * len(own.ids)
        for b in parts:
            for batch, terms, most in zip(*(c.to_pylist() for c in b.columns)):
                t = np.frombuffer(terms, np.int32)
                tree = Batch(np.zeros(1), np.zeros(1), np.array([0, len(t)]), t, np.frombuffer(most, np.int32), own.size, own.exact)
                for i, (terms_, weights) in enumerate(own.levels[0]):
                    best[i] = max(best[i], (int(tree.sums(0, np.zeros(1, np.int64), terms_, weights)[0]), batch))
        got = [(i, b, s) for i, (s, b) in enumerate(best) if s > 0]
        cols = list(zip(*got)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "batch", "bound"])
    got = packed.select("batch", "top_terms", "top_impact").mapInArrow(rows, "item long, batch long, bound long")
    return got.groupBy("item").agg(F.max_by("batch", "bound").alias("batch"))


def find(packed: DataFrame, items, floor, k: int) -> DataFrame:
    """``FOUND``: each task's k best documents per item, at ``floor`` or above."""
    def rows(parts: Iterator[pa.RecordBatch]):
        own = items.value
        finder = Finder(own, floor.value, k)
        for b in parts:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                ids, known, starts, terms, impact = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, bool, np.int64, np.int32, np.int32)))
                finder.search(Batch(ids, known, starts, terms, impact, own.size, own.exact))
        yield finder.rows()
    return packed.select("ids", "known", "starts", "terms", "impact").mapInArrow(rows, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item_id, rank, doc_id, score for one block of (item_id, term, times) rows."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    at = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.schema(df.schema).parquet(f"{at}/{name}")

    number = {t: n for n, t in enumerate(sorted({r["term"] for r in rows}))}
    read = kept(read_documents(docs, send({t.encode(): n for t, n in number.items()})), "read")
    documents, length, df = corpus_totals(read, len(number))
    weights = np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)
    tree = Items([(r["item_id"], number[r["term"]], r["times"]) for r in rows], weights)
    tree.size = len(number)
    items = send(tree)
    with batch_rows(spark, 8):             # a row is a whole batch of documents
        packed = kept(pack(read, send(weights), documents, length, len(number)), "packed")
        first = sorted({r["batch"] for r in promising(packed, items).collect()})     # one per item at most
        seeds = cut_lineage(ranked(find(packed.where(F.col("batch").isin(first)), items, send(np.zeros(len(tree.ids), np.int64)), k), k))
        floor = np.zeros(len(tree.ids), np.int64)
        for r in seeds.where(F.col("rank") == k).collect():      # one row per item
            floor[r["item"]] = r["score"]
        rest = find(packed.where(~F.col("batch").isin(first)), items, send(floor), k)
        out = cut_lineage(ranked(seeds.drop("rank").unionByName(rest), k).select("item_id", "rank", "doc_id", "score"))
    discard(spark, at)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of highest score above 0 of every
    item, equal scores by ascending doc_id. Items meet all documents block by block."""
    wanted = cut_lineage(item_terms(items))
    blocks = max(1, -(-wanted.count() // ITEM_TERMS))
    own = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        rows = wanted.where(own == b).collect()        # one block of items
        if rows:
            parts.append(search_block(docs, rows, k))
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return functools.reduce(DataFrame.unionByName, parts)


_TERMS_SQL = (f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
              r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS ts FROM documents),
a AS (SELECT count(*) AS nd, sum(len(ts))::BIGINT AS ld FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
t AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM t, a GROUP BY term, nd),
m AS (SELECT row, doc_id, 100 - 75 + (75 * len(ts) * nd) // ld AS m FROM d, a WHERE len(ts) > 0),
s AS (SELECT item_id, row, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN t USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM s JOIN m USING (row) WHERE score > 0) WHERE rank <= {K}
"""
