"""Encoding with a public byte-level BPE vocabulary, token counts and packing.

``encoder`` reads the tokenizer file (its path is a parameter) and encodes with the same
vocabulary and merges in tiktoken's engine: the ids equal those of the ``tokenizers``
library (a test compares them), at a fifth of the CPU time.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, staged, texts_of

END_ID = 0          # closes a document
CONTEXT = 1024
TIERS = (1024, 512, 256, 128)  # window sizes of the packing tiers
BLOCK = 256         # lengths per block of the suffix sums


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


# --- fixed values: the split pattern of byte-level BPE ---------------------------------
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# ---------------------------------------------------------------------------------------


def _byte_of_letter() -> dict[str, int]:
    """Letters that stand for bytes in the vocabulary: printable Latin-1 for itself, the
    others from U+0100 on, in order."""
    out, n = {}, 0
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out[chr(b)] = b
        else:
            out[chr(0x100 + n)] = b
            n += 1
    return out


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids, by the vocabulary file at ``path``."""
    import tiktoken
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of = _byte_of_letter()
    ranks = {bytes(of[x] for x in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in special}
    enc = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: enc.encode(text, allowed_special="all") if text else []


# --- token counts ----------------------------------------------------------------------

def encoded_lengths(docs: DataFrame, path: str) -> DataFrame:
    """length: number of ids of each document (null text: 0); one row per document."""
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(path)
        return pa.RecordBatch.from_arrays([pa.array([len(enc(t.decode())) for t in texts_of(batch)], pa.int64())], ["length"])
    return arrow_map(docs.select("text"), count, "length long")


def length_histogram(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Exact histogram of encoded lengths with suffix sums: for every length L that occurs

    n_docs, n_tokens    documents of that length and their ids
    docs_from, tokens_from   documents of length L or more, and their ids
    truncated_total     ids left when every document is cut at L (sum of min(length, L))
    share_upto          share of documents of length L or less (read quantiles from it)

    Documents are aggregated before anything is shuffled; the suffix sums run per block of
    ``BLOCK`` lengths over the totals of the blocks above, so no task holds all lengths.
    Empty and null texts count as length 0; an empty table gives no rows; repeated rows
    count as often as they occur; other columns are not read."""
    hist = (encoded_lengths(docs, path or default_tokenizer()).groupBy("length")
            .agg(F.count(F.lit(1)).alias("n_docs"))
            .withColumn("n_tokens", F.col("length") * F.col("n_docs"))
            .withColumn("block", F.floor(F.col("length") / BLOCK)))
    from ..session import cut_lineage
    hist = cut_lineage(hist)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = (hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
              .select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                      F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                      F.sum("d").over(whole).alias("d_all"), F.sum("t").over(whole).alias("t_all")))
    here = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = hist.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", "d_all", "t_all",
        (F.sum("n_docs").over(here) + F.col("d_above")).alias("docs_from"),
        (F.sum("n_tokens").over(here) + F.col("t_above")).alias("tokens_from"))
    return out.select(
        "length", "n_docs", "n_tokens", "docs_from", "tokens_from",
        (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_from") + F.col("n_docs")) / F.col("d_all")).alias("share_upto"))


def _rows(histogram: DataFrame, schema: str, rows: list) -> DataFrame:
    """One row per struct in ``rows``, aggregates of the histogram: one pass for all of them."""
    return histogram.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*").to(
        histogram.sparkSession.createDataFrame([], schema).schema)


def totals_at(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, n_longer, truncated_total for any context limits, looked up in the suffix sums:
    documents from the first length at or above a limit are cut to it, the others stay whole."""
    if not limits:
        return histogram.sparkSession.createDataFrame([], "limit long, n_longer long, truncated_total long")
    everything = F.coalesce(F.max("tokens_from"), F.lit(0))
    sums = F.struct("length", "docs_from", "tokens_from")

    def at(x: int):
        cut, longer = F.min(F.when(F.col("length") >= x, sums)), F.min(F.when(F.col("length") > x, sums))
        total = everything - F.coalesce(cut["tokens_from"], F.lit(0)) + F.coalesce(cut["docs_from"], F.lit(0)) * x
        return F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(longer["docs_from"], F.lit(0)).alias("n_longer"),
                        total.alias("truncated_total"))
    return _rows(histogram, "limit long, n_longer long, truncated_total long", [at(int(x)) for x in limits])


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """share, length: the least length that so large a share of the documents doesn't exceed
    (null without documents)."""
    if not shares:
        return histogram.sparkSession.createDataFrame([], "share double, length long")
    return _rows(histogram, "share double, length long", [
        F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_upto") >= q, F.col("length"))).alias("length")) for q in shares])


# --- packing ---------------------------------------------------------------------------

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, tier int, step_group int")
STEP_GROUPS = 8
HELD = 4096  # remainders packed together; bounds a task's memory to HELD * CONTEXT ids
TASK_SHIFT = 33  # a task's sequences are numbered from (partition << TASK_SHIFT)


def tiers_of(context: int) -> tuple[int, ...]:
    """Window sizes, the longest first."""
    return (context, *(t for t in TIERS if t < context))


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The shortest tier that holds ``length`` ids."""
    return next(t for t in reversed(tiers) if length <= t)


def fill_windows(lengths: np.ndarray, context: int = CONTEXT, tiers: tuple[int, ...] = ()) -> tuple[list[list[int]], list[int]]:
    """Packs items (none longer than ``context``) into windows of ``tiers`` (by default
    ``context`` alone), uncut.

    Longest first, an item opens a window of its own tier (see ``tier_of``), and the gap is
    filled with the longest items that fit, which come from shorter tiers, or in the
    shortest from its own. Returns (windows as lists of items, the opening one first, the
    fill of each)."""
    tiers = tiers or (context,)
    by_len: list[list[int]] = [[] for _ in range(context + 1)]
    for i in range(len(lengths) - 1, -1, -1):
        by_len[int(lengths[i])].append(i)
    there = sum(1 << n for n in range(1, context + 1) if by_len[n])  # bit n: items of length n

    def take(room: int) -> tuple[int, int]:
        nonlocal there
        n = (there & ((2 << room) - 1)).bit_length() - 1
        if n < 1:
            return -1, 0
        i = by_len[n].pop()
        if not by_len[n]:
            there ^= 1 << n
        return i, n

    windows, fills = [], []
    while there:
        i, fill = take(context)
        window, size = [i], tier_of(fill, tiers)
        while fill < size:
            i, n = take(size - fill)
            if i < 0:
                break
            window.append(i)
            fill += n
        windows.append(window)
        fills.append(fill)
    return windows, fills


def cut_windows(lengths: list[int], tiers: tuple[int, ...]) -> list[list[tuple[int, int, int]]]:
    """Packs items like ``fill_windows``, but a gap that no item fits takes the head of the
    shortest one left, whose tail goes to the tier of its own length: all windows are full
    but the last. Returns windows as lists of (item, start, length)."""
    left = sorted((n, -i, 0) for i, n in enumerate(lengths))
    windows = []
    while left:
        n, i, start = left.pop()
        window, room = [(-i, start, n)], tier_of(n, tiers) - n
        while room and left:
            at = bisect_right(left, room, key=lambda x: x[0])
            n, i, start = left.pop(max(at - 1, 0))
            if n > room:
                insort(left, (n - room, i, start + room))
                n = room
            window.append((-i, start, n))
            room -= n
        windows.append(window)
    return windows


def deal_groups(counts: list[tuple[int, int, int, int]]) -> list[tuple[int, int, list[int], int]]:
    """(task, tier, full windows, ids of the task's window short of full or 0) ->
    (task, tier, groups that its full windows go to in turn, group of the short one).

    In each tier the full windows of all tasks go round the groups in one turn, which
    starts at the group with the fewest ids so far; the short windows, longest first, go
    where the tier has the fewest ids. So groups differ by one window at most in any tier."""
    total = [0] * STEP_GROUPS
    out = []
    for tier in sorted({c[1] for c in counts}, reverse=True):
        here = sorted(c for c in counts if c[1] == tier)
        order = sorted(range(STEP_GROUPS), key=lambda g: (total[g], g))
        done, firsts = 0, {}
        for task, _, full, _ in here:
            firsts[task] = done % STEP_GROUPS
            done += full
        load = [0] * STEP_GROUPS
        for k, g in enumerate(order):
            load[g] = tier * ((done + STEP_GROUPS - 1 - k) // STEP_GROUPS)
        short = {}
        for task, _, _, ids in sorted(here, key=lambda c: (-c[3], c[0])):
            if ids:
                g = short[task] = min(range(STEP_GROUPS), key=lambda g: (load[g], total[g], g))
                load[g] += ids
        total = [a + b for a, b in zip(total, load)]
        out += [(task, tier, order[at:] + order[:at], short.get(task, 0)) for task, at in firsts.items()]
    return out


def pack(docs: DataFrame, path: str | None = None, context: int = CONTEXT) -> DataFrame:
    """One row per piece: see ``PIECES``.

    A document is its ids and id 0. Whole windows of a long document become sequences of
    their own; the remainder is routed to a tier by length and packed with the remainders
    of the same task, ``HELD`` at a time: each tier has windows of its own size, and gaps
    are filled from shorter tiers. Windows short of full are held over and opened again with
    the next remainders; once they are half of ``HELD``, and at the end of a task, gaps are
    filled by cutting pieces, so a task has one window short of full at most. ``tier`` is
    the size of the sequence's window.

    ``step_group`` is dealt per tier over all tasks (see ``deal_groups``): the pieces are
    staged, and a table of each task's windows per tier gives the places of its turns.

    A task's sequences are numbered from (partition << 33), and rows keep the order in
    which the scan delivers them, so a retried task gives the same rows.
    Null or empty text: one piece of length 1 (id 0). Repeated rows and null doc_ids are
    packed like any other row. An empty table gives no rows; extra columns are ignored."""
    path = path or default_tokenizer()
    tiers = tiers_of(context)

    def crc(ids: np.ndarray) -> int:
        return zlib.crc32(ids.tobytes())

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << TASK_SHIFT
        enc = encoder(path)
        made = 0
        turns = dict.fromkeys(tiers, 0)
        rows: list[tuple] = []

        def emit(window: list[tuple], tier: int) -> None:
            """``step_group`` is the window's turn in its task and tier here, -1 if it is short of full."""
            nonlocal made
            at = 0
            full = sum(len(ids) for _, _, ids, _ in window) == tier
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), crc(ids), total, base + made, at, tier,
                             turns[tier] % STEP_GROUPS if full else -1))
                at += len(ids)
            turns[tier] += full
            made += 1

        def flush() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows))
            types = [pa.int64()] * 7 + [pa.int32()] * 2
            names = [x.split()[0] for x in PIECES.split(", ")]
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        def pack_held(held: list[tuple], last: bool) -> list[tuple]:
            windows, fills = fill_windows(np.array([len(x[2]) for x in held], dtype=np.int64), context, tiers)
            over: list[tuple] = []
            for items, fill in zip(windows, fills):
                tier = tier_of(len(held[items[0]][2]), tiers)
                if fill == tier:
                    emit([held[i] for i in items], tier)
                else:
                    over.extend(held[i] for i in items)
            if not last and len(over) < HELD // 2:
                return over
            for pieces in cut_windows([len(x[2]) for x in over], tiers):
                window = [(over[i][0], over[i][1] + s, over[i][2][s:s + n], over[i][3]) for i, s, n in pieces]
                tier = tier_of(pieces[0][2], tiers)
                if not last and sum(n for _, _, n in pieces) < tier:
                    return window
                emit(window, tier)
            return []

        held: list[tuple] = []
        for b in batches:
            ids_of = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            for doc, text in zip(ids_of, texts_of(b)):
                ids = np.array([*enc(text.decode()), END_ID], dtype="<u4")
                whole = len(ids) // context * context
                for s in range(0, whole, context):
                    emit([(doc, s, ids[s:s + context], len(ids))], context)
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:].copy(), len(ids)))
                if len(held) >= HELD:
                    held = pack_held(held, False)
            if rows:
                yield flush()
        if held:
            pack_held(held, True)
        if rows:
            yield flush()

    pieces = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES), "pack")
    task = F.shiftright("sequence_id", TASK_SHIFT)
    short = F.col("step_group") < 0
    counts = (pieces.groupBy(task.alias("task"), "tier")
              .agg(F.count(F.when(~short & (F.col("offset") == 0), 1)), F.coalesce(F.sum(F.when(short, F.col("length"))), F.lit(0))))
    dealt = docs.sparkSession.createDataFrame(deal_groups([tuple(r) for r in counts.collect()]),
                                              "__task long, tier int, __groups array<int>, __short int")
    return (pieces.withColumn("__task", task).join(F.broadcast(dealt), ["__task", "tier"])
            .withColumn("step_group", F.when(short, F.col("__short")).otherwise(F.get("__groups", F.col("step_group"))))
            .select(*[x.split()[0] for x in PIECES.split(", ")]))
