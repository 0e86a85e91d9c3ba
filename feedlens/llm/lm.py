"""Language-model scoring by deleted interpolation.

Tokens are the words of a text (A-Z lower-cased) and one end; all words that the learning
documents don't hold are one unknown token. The model mixes, for a token after another,

* the maximum-likelihood bigram estimate, * the unigram estimate, * the uniform
distribution over known words and the unknown one, * all on the unknown one,

with weights for each bucket of the context's frequency (powers of two). The weights are
learned by expectation-maximisation: estimates come from the learning documents without
fold ``EM_FOLD``, the held-out counts that they must explain from that fold. The final
estimates use the counts of all learning documents. A start mark is the first context.

On Spark, documents are first written as chunks of about ``CHUNK_BYTES`` (rows of a Parquet
table in the shared folder), so a chunk is the same in every later pass. A chunk reports
each of its distinct n-grams once, as 64-bit keys with its counts, packed by key range; a
task adds up one range of keys from all chunks and answers each chunk with the corpus counts
of its keys. So what is shuffled follows the distinct n-grams per chunk in eight bytes each,
however hot an n-gram is, and no table of n-grams is ever in one place.

Defined cases: null text is empty (one token, the end); a null doc_id is never held out and
learned from; with nothing learned every token is unknown and scores 0; rows that share a
doc_id are scored each; a very long text makes a chunk of its own, read whole; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage
from .common import batch_rows, discard, mix64

FOLDS, HELD_OUT, EM_FOLD = 7, 2, 3
CHUNK_BYTES = 6 << 20
RANGE_BYTES = 12 << 20     # bytes of text for which one range of keys is made
MIN_RANGES = 48
ROUNDS = 60
BINS = 20                  # bins per power of ten of an estimate, for the held-out counts
NEVER = -10_000            # bin of an estimate that is 0
BUCKETS = 64
START = np.uint64(0x5354415254)  # hash of the first context
RESULT = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
          "base_score double, score double")


def fold(doc_id) -> int:
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % FOLDS


def tokens(text: str | None) -> list[bytes]:
    return [*(text or "").encode().lower().split(), b""]


class Chunk:
    """Documents as arrays: for every token the places of its unigram and bigram among the
    chunk's sorted keys."""

    def __init__(self, docs: pa.Table):
        self.doc_ids = docs.column("doc_id").to_pylist()
        self.folds = np.array([fold(d) for d in self.doc_ids], dtype=np.int64)
        known: dict[bytes, int] = {}
        lists = [np.fromiter((known.setdefault(w, len(known)) for w in tokens(t)), dtype=np.int64)
                 for t in docs.column("text").to_pylist()]
        self.lengths = np.array([len(x) for x in lists], dtype=np.int64)
        words = np.concatenate(lists)
        self.starts = np.cumsum(self.lengths) - self.lengths
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), dtype=np.uint64, count=len(known))
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.uni_keys, self.uni = hashes[order], place[words]
        before = np.concatenate([[0], self.uni[:-1]])
        context = self.uni_keys[before]
        context[self.starts] = START
        pairs = mix64(context * np.uint64(0x9E3779B97F4A7C15) + self.uni_keys[self.uni])
        self.bi_keys, first, self.bi = np.unique(pairs, return_index=True, return_inverse=True)
        # of each distinct bigram: the place of its word, and of its context (-1: start)
        before[self.starts] = -1
        self.bi_word, self.bi_context = self.uni[first], before[first]
        self.end = int(place[known[b""]])

    def counts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unigram, bigram) counts over the documents of ``which``."""
        use = np.repeat(which, self.lengths)
        return (np.bincount(self.uni[use], minlength=len(self.uni_keys)), np.bincount(self.bi[use], minlength=len(self.bi_keys)))


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Range of each key; it grows with the key."""
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def squeeze(a: np.ndarray) -> bytes:
    """Numbers as compressed byte planes: the high bytes of small numbers vanish."""
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.copy()
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def loosen(data: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), dtype=np.uint8)
    return planes.reshape(size, n).T.copy().view(kind).ravel()


def unpack(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


# --- passes -----------------------------------------------------------------------------

def chunks(docs: DataFrame) -> DataFrame:
    """chunk, em, bytes, data: documents packed as compressed Arrow streams, those of the EM
    fold apart from the others."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(em: bool) -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                ids, texts = zip(*held[em])
                w.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())}))
            out = pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([em]), pa.array([size[em]], pa.int64()),
                                              pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "em", "bytes", "data"])
            held[em], size[em] = [], 0
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                em = fold(doc_id) == EM_FOLD
                held[em].append((doc_id, text))
                size[em] += len(text or "")
                if size[em] >= CHUNK_BYTES:
                    yield flush(em)
        for em in held:
            if held[em]:
                yield flush(em)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(run, "chunk string, em boolean, bytes long, data binary"))


KEYS = "range int, chunk string, em boolean, kind int, n int, keys binary, counts binary"


def names_of(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def keys_of(table: DataFrame, ranges: int) -> DataFrame:
    """The distinct n-grams of each chunk with its counts, one row per range and order: steps
    between the sorted keys, and counts over the chunk's learning documents."""
    def run(batches: Iterator[pa.RecordBatch]):
        types = [pa.int32(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for b in batches:
            for name, em, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                c = Chunk(unpack(data))
                rows = []
                learned = c.counts(c.folds != HELD_OUT)
                for kind, keys, n in ((1, c.uni_keys, learned[0]), (2, c.bi_keys, learned[1])):
                    n = n.astype("<u4")
                    own = range_of(keys, ranges)
                    cuts = np.flatnonzero(np.diff(own, prepend=-1))
                    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                        rows.append((int(own[i]), name, em, kind, j - i, squeeze(np.diff(keys[i:j], prepend=np.uint64(0))), squeeze(n[i:j])))
                for at in range(0, len(rows), 256):
                    cols = zip(*rows[at:at + 256])
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types)], names_of(KEYS))
    return table.select("chunk", "em", "data").mapInArrow(run, KEYS)


COUNTS = "chunk string, of_em boolean, range int, kind int, n int, fit binary, em binary, known long, fit_n long, em_n long"


def add_up(table: pa.Table) -> pa.Table:
    """Corpus counts (64 bits; a chunk's own fit 32) of one range of keys: an answer to each
    chunk, and once (chunk null) the range's known unigrams and their counts."""
    out = []
    for kind in (1, 2):
        rows = table.filter(pc.equal(table.column("kind"), kind)).to_pylist()
        if not rows:
            continue
        keys = np.concatenate([np.cumsum(loosen(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in rows])
        kinds, back = np.unique(keys, return_inverse=True)
        counts = np.concatenate([loosen(r["counts"], r["n"], "<u4") for r in rows]).astype(np.float64)
        of_em = np.repeat([r["em"] for r in rows], [r["n"] for r in rows])
        fit, em = (np.bincount(back, counts * part, len(kinds)).astype("<u8") for part in (~of_em, of_em))
        if kind == 1:
            out.append((None, None, rows[0]["range"], 0, 0, None, None, int(((fit > 0) | (em > 0)).sum()),
                        int(fit.sum(dtype=np.int64)), int(em.sum(dtype=np.int64))))
        at = 0
        for r in rows:
            mine = back[at:at + r["n"]]
            out.append((r["chunk"], r["em"], r["range"], kind, r["n"], squeeze(fit[mine]), squeeze(em[mine]), 0, 0, 0))
            at += r["n"]
    types = [pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types)], names=names_of(COUNTS))


def answers(table: pa.Table) -> dict[tuple[int, str], np.ndarray]:
    """(kind, part) -> corpus counts in the order of a chunk's keys."""
    rows = sorted(table.select(["range", "kind", "n", "fit", "em"]).to_pylist(), key=lambda r: r["range"])
    return {(kind, part): np.concatenate([loosen(r[part], r["n"], "<u8") for r in rows if r["kind"] == kind]).astype(np.float64)
            for kind in (1, 2) for part in ("fit", "em")}


def estimates(c: Chunk, uni: np.ndarray, bi: np.ndarray, starts: float, total: float) -> tuple[np.ndarray, ...]:
    """For each distinct bigram of a chunk: bigram and unigram estimate, bucket of the context."""
    context = np.where(c.bi_context < 0, starts, uni[c.bi_context])
    return (bi / np.maximum(context, 1), uni[c.bi_word] / max(total, 1),
            np.ceil(np.log2(context + 1)).astype(np.int64))


def bin_of(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.round(np.log10(p) * BINS), NEVER).astype(np.int64)


def learn(held: list[tuple[int, int, int, float]], uniform: float) -> np.ndarray:
    """EM: weights (bucket x bigram, unigram, uniform, unknown) from held-out counts by
    (bucket, bin of the bigram estimate, bin of the unigram estimate)."""
    weights = np.tile([0.3, 0.3, 0.1, 0.3], (BUCKETS, 1))
    if not held:
        return weights
    bucket, two, one, n = (np.array(x) for x in zip(*held))
    est = np.zeros((len(n), 4))
    est[:, 0] = np.where(two == NEVER, 0, 10.0 ** (two / BINS))
    est[:, 1] = np.where(one == NEVER, 0, 10.0 ** (one / BINS))
    est[:, 2] = uniform
    est[:, 3] = one == NEVER
    for _ in range(ROUNDS):
        share = est * weights[bucket]
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(4)], axis=1)
        total += 0.01  # no weight becomes 0; a bucket without events keeps even ones
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    at = f"{checkpoint_dir(spark)}/lm-{uuid.uuid4().hex}"
    chunks(docs).write.parquet(f"{at}/chunks")
    table = spark.read.schema("chunk string, em boolean, bytes long, data binary").parquet(f"{at}/chunks")
    with batch_rows(spark, 4):
        size = table.agg(F.sum("bytes")).first()[0] or 0
        ranges = max(MIN_RANGES, -(-size // RANGE_BYTES))
        (keys_of(table, ranges).groupBy("range").applyInArrow(add_up, COUNTS).write.parquet(f"{at}/counts"))
        counts = spark.read.schema(COUNTS).parquet(f"{at}/counts")
        known, fit_n, em_n = (x or 0 for x in counts.where("chunk is null").agg(F.sum("known"), F.sum("fit_n"), F.sum("em_n")).first())
        answered = counts.where("chunk is not null").select("chunk", "of_em", "range", "kind", "n", "fit", "em")
        total = fit_n + em_n

        def held_counts(docs_of: pa.Table, answer: pa.Table) -> pa.Table:
            c, n = Chunk(unpack(docs_of.column("data")[0].as_py())), answers(answer)
            two, one, bucket = estimates(c, n[1, "fit"], n[2, "fit"], n[1, "fit"][c.end], fit_n)
            events = np.stack([bucket, bin_of(two), bin_of(one)])
            kinds, back = np.unique(events, axis=1, return_inverse=True)
            found = np.bincount(back.ravel(), np.bincount(c.bi, minlength=len(c.bi_keys)), kinds.shape[1])
            return pa.table([*(pa.array(x) for x in kinds), pa.array(found)], names=["bucket", "two", "one", "n"])

        em = (table.where("em").select("chunk", "data").groupBy("chunk")
              .cogroup(answered.where("of_em").groupBy("chunk"))
              .applyInArrow(held_counts, "bucket long, two long, one long, n double"))
        weights = learn([tuple(r) for r in em.groupBy("bucket", "two", "one").agg(F.sum("n")).collect()], 1 / (known + 1))

        def rate(docs_of: pa.Table, answer: pa.Table) -> pa.Table:
            c, n = Chunk(unpack(docs_of.column("data")[0].as_py())), answers(answer)
            uni, bi = n[1, "fit"] + n[1, "em"], n[2, "fit"] + n[2, "em"]
            two, one, bucket = estimates(c, uni, bi, uni[c.end], total)
            w = weights[bucket]
            model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (known + 1) + w[:, 3] * (one == 0)) if total else np.zeros(len(two))
            base = np.log10((uni + 1) / (total + 1 * (known + 1)))
            sums = [np.add.reduceat(x, c.starts) for x in (uni[c.uni] > 0, base[c.uni], model[c.bi])]
            return pa.table([pa.array(c.doc_ids, pa.int64()), pa.array(c.folds == HELD_OUT), pa.array(c.lengths),
                             pa.array(sums[0].astype(np.int64)), pa.array([total] * len(c.doc_ids), pa.int64()),
                             pa.array(sums[1]), pa.array(sums[2])], names=names_of(RESULT))

        scored = cut_lineage(table.select("chunk", "data").groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(rate, RESULT))
    discard(spark, at)
    return scored
