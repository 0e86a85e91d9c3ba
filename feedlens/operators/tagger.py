"""Entity tagger (T8): a hidden Markov model over word tokens, fitted in Spark.

Tokens carry tags O, B (a name begins) and I (it goes on). Fitting counts, over all labelled
texts, transitions between tags and words (with their shape) per tag; each Arrow batch adds up
its own tokens before anything is shuffled. Words that begin or continue a name are observed
as themselves (the ``MAX_WORDS`` most frequent of them), all others by their shape, so names
that were never seen can still be found by how they are written and where they stand. What a
task holds is that model: ``MAX_WORDS`` words and a few shapes, whatever the corpus.

Decoding is Viterbi over the windows of ``mentions.with_model_spans``, so whole texts are
read; the windows of an Arrow batch go a word at a time, all at once; spans are runs of B I*. Texts without tokens have no spans; null texts and null labels
count as texts without names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKEN = re.compile(r"\w+(?:[&'’-]\w+)*|[^\w\s]")
TAGS = O, B, I = 0, 1, 2
MAX_WORDS = 50_000
SMOOTH = 0.1
LABEL, SCORE = "ORG", 0.85
COUNTS = "kind string, word string, shape string, tag int, n long"


def shape(word: str) -> str:
    """How a word is written: its kinds of characters in order, runs cut to one."""
    out = ""
    for c in word[:12]:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if not out.endswith(k):
            out += k
    return out


def tagged(text: str, spans: list[dict]) -> list[tuple[str, int]]:
    """(word, tag) of a text whose names are ``spans`` (start_char, end_char)."""
    ends = {int(s["start_char"]): int(s["end_char"]) for s in spans}
    out, until = [], -1
    for m in TOKEN.finditer(text):
        if m.start() in ends and m.start() >= until:
            until = ends[m.start()]
            out.append((m.group(), B))
        else:
            out.append((m.group(), I if m.end() <= until else O))
    return out


def islands(text: str, spans: list[dict]) -> Iterator[tuple[str, list[dict]]]:
    """A text in pieces, cut behind blanks (which no token holds): those with names and their
    spans there, and those between them without."""
    at, n = 0, len(text)
    cuts: list[tuple[int, int, list[dict]]] = []
    for s in sorted(({"start_char": int(s["start_char"]), "end_char": int(s["end_char"])} for s in spans), key=lambda s: s["start_char"]):
        if not 0 <= s["start_char"] < n:
            continue
        end = text.find(" ", max(s["end_char"], s["start_char"] + 1))
        end = n if end < 0 else end + 1
        if cuts and s["start_char"] < cuts[-1][1]:
            cuts[-1] = (cuts[-1][0], max(end, cuts[-1][1]), [*cuts[-1][2], s])
        else:
            last = cuts[-1][1] if cuts else 0
            cuts.append((max(text.rfind(" ", last, s["start_char"]) + 1, last), end, [s]))
    for lo, hi, own in cuts:
        yield text[at:lo], []
        yield text[lo:hi], [{"start_char": s["start_char"] - lo, "end_char": s["end_char"] - lo} for s in own]
        at = hi
    yield text[at:], []


def count_tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``COUNTS`` of each Arrow batch of (text, spans): emissions ``e``, transitions ``t``
    (``word`` is the tag before; texts begin and end with O)."""
    for b in batches:
        plain: Counter = Counter()
        words: Counter = Counter()
        steps: Counter = Counter()
        for text, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            last = O
            for piece, names in islands(text or "", spans or []):
                if names:
                    for word, tag in tagged(piece, names):
                        words[word, tag] += 1
                        steps[last, tag] += 1
                        last = tag
                elif found := TOKEN.findall(piece):
                    plain.update(found)
                    steps[last, O] += 1
                    steps[O, O] += len(found) - 1
                    last = O
            steps[last, O] += 1
        for word, n in plain.items():
            words[word, O] += n
        steps = +steps
        rows = [("e", w, shape(w), t, n) for (w, t), n in words.items()] + [("t", str(a), None, t, n) for (a, t), n in steps.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))],
                                         names=[x.split()[0] for x in COUNTS.split(", ")])


class Tagger:
    """log probabilities of transitions and observations; ``extract`` finds the names of a text,
    ``many`` those of many at once."""
    CHUNK = 2048       # texts that are decoded together

    def __init__(self, steps: dict[tuple[int, int], int], words: dict[str, dict[int, int]], shapes: dict[str, dict[int, int]]):
        def table(seen: dict, of: dict[int, float]) -> dict[str, tuple[float, ...]]:
            return {k: tuple(math.log((n.get(t, 0) + SMOOTH) / of[t]) for t in TAGS) for k, n in seen.items()}
        size = len(words) + len(shapes) + 1
        total = {t: sum(n.get(t, 0) for seen in (words, shapes) for n in seen.values()) + SMOOTH * size for t in TAGS}
        self.words, self.shapes = table(words, total), table(shapes, total)
        self.unknown = tuple(math.log(SMOOTH / total[t]) for t in TAGS)
        self.steps = [[math.log((steps.get((a, t), 0) + SMOOTH) / (sum(steps.get((a, x), 0) for x in TAGS) + SMOOTH * 3)) for t in TAGS] for a in TAGS]
        self.steps[O][I] = -math.inf       # a name goes on only where one began

    def seen(self, word: str) -> tuple[float, ...]:
        return self.words.get(word) or self.shapes.get(shape(word), self.unknown)

    def tags(self, words: list[str]) -> list[int]:
        """The most probable tags (Viterbi)."""
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.steps
        o, b, i = 0.0, -math.inf, -math.inf
        back = []
        for w in words:
            eo, eb, ei = self.seen(w)
            to = max((o + oo, O), (b + bo, B), (i + io, I))
            tb = max((o + ob, O), (b + bb, B), (i + ib, I))
            ti = max((b + bi, B), (i + ii, I))
            back.append((to[1], tb[1], ti[1]))
            o, b, i = to[0] + eo, tb[0] + eb, ti[0] + ei
        end = max((o + oo, O), (b + bo, B), (i + io, I))[1]
        out = []
        for step in reversed(back):
            out.append(end)
            end = step[end]
        return out[::-1]

    def names(self, text: str, words: list[str], tags: list[int]) -> list[dict]:
        """The spans of tagged words; a word is the next one in the text, behind blanks at most."""
        out: list[dict] = []
        at = 0
        for word, tag in zip(words, tags):
            start = text.index(word, at)
            at = start + len(word)
            if tag == B:
                out.append({"start_char": start, "end_char": at, "label": LABEL, "score": SCORE})
            elif tag == I and out:
                out[-1]["end_char"] = at
        return out

    def extract(self, text: str) -> list[dict]:
        words = TOKEN.findall(text)
        return self.names(text, words, self.tags(words))

    __call__ = extract

    def many(self, texts: list[str]) -> list[list[dict]]:
        """``extract`` of every text."""
        out: list[list[dict]] = []
        for at in range(0, len(texts), self.CHUNK):
            some = texts[at:at + self.CHUNK]
            words = [TOKEN.findall(t) for t in some]
            for text, own, tags in zip(some, words, self.tags_of(words)):
                named = np.flatnonzero(tags)
                out.append(self.names(text, own[:named[-1] + 1], tags.tolist()) if len(named) else [])
        return out

    def tags_of(self, texts: list[list[str]]) -> list[np.ndarray]:
        """``tags`` of every list of words: the k-th words of all lists in one step, the longest
        lists first, so that those that have a k-th word are the first ones."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        longest = int(sizes.max(initial=0))
        live = len(texts) - np.searchsorted(np.sort(sizes), np.arange(longest), side="right")
        ends = np.cumsum(live)
        # where the words of a step lie among all words, step by step
        first = (np.cumsum(sizes) - sizes)[order]
        place = np.concatenate([first[:n] + k for k, n in enumerate(live)]) if longest else np.empty(0, dtype=np.int64)
        coded = pa.array(list(chain.from_iterable(texts)), pa.large_string()).dictionary_encode()       # a look-up per distinct word
        table = np.array([self.seen(w) for w in coded.dictionary.to_pylist()]).reshape(-1, 3)
        eo, eb, ei = table[coded.indices.to_numpy()[place]].T.copy()
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.steps
        o, b, i = np.zeros(len(texts)), np.full(len(texts), -math.inf), np.full(len(texts), -math.inf)
        back = np.empty((3, len(place)), dtype=np.int8)

        def best(x, y, z):
            """The largest value and its tag, the later tag of equal ones."""
            v = np.maximum(x, y)
            return np.maximum(v, z), np.where(z >= v, np.int8(I), y >= x)
        for n, hi in zip(live, ends):
            at = slice(hi - n, hi)
            po, pb, pi = o[:n], b[:n], i[:n]
            to, back[O, at] = best(po + oo, pb + bo, pi + io)
            tb, back[B, at] = best(po + ob, pb + bb, pi + ib)
            x, y = pb + bi, pi + ii
            back[I, at] = (y >= x) + np.int8(B)
            o[:n], b[:n], i[:n] = to + eo[at], tb + eb[at], np.maximum(x, y) + ei[at]
        end = best(o + oo, b + bo, i + io)[1]
        out = np.empty(len(place), dtype=np.int8)
        for n, hi in zip(live[::-1], ends[::-1]):
            at = slice(hi - n, hi)
            own = end[:n]
            out[at] = own
            own[:] = np.where(own == O, back[O, at], np.where(own == B, back[B, at], back[I, at]))
        tags = np.empty(len(place), dtype=np.int8)
        tags[place] = out
        return np.split(tags, np.cumsum(sizes)[:-1]) if texts else []

    def loader(self) -> Callable[[], Callable[[str], list[dict]]]:
        """What ``mentions.with_model_spans`` runs once per Python worker."""
        return lambda: self


def fit(labelled: DataFrame, spans_col: str = "spans", text_col: str = "text", max_words: int = MAX_WORDS) -> Tagger:
    """The tagger of texts whose names are known: ``spans_col`` is an array of structs with
    start_char and end_char. Counts over all texts; what comes back to the driver is bounded by
    ``max_words`` and the shapes that occur."""
    rows = labelled.select(F.col(text_col), F.transform(spans_col, lambda s: F.struct(
        s["start_char"].cast("long").alias("start_char"), s["end_char"].cast("long").alias("end_char"))).alias("spans"))
    n = cut_lineage(rows.mapInArrow(count_tags, COUNTS).groupBy("kind", "word", "shape", "tag").agg(F.sum("n").alias("n")))
    steps = {(int(r["word"]), r["tag"]): r["n"] for r in n.where("kind = 't'").collect()}      # nine rows
    in_names = (n.where(f"kind = 'e' AND tag <> {O}").groupBy("word").agg(F.sum("n").alias("in_names"))
                .orderBy(F.desc("in_names"), "word").limit(max_words))
    own = n.where("kind = 'e'").join(in_names.select("word"), "word", "left_semi")
    words: dict[str, dict[int, int]] = {}
    for r in own.collect():                                    # max_words words, three tags
        words.setdefault(r["word"], {})[r["tag"]] = r["n"]
    shapes: dict[str, dict[int, int]] = {}
    others = n.where("kind = 'e'").join(in_names.select("word"), "word", "left_anti").groupBy("shape", "tag").agg(F.sum("n").alias("n"))
    for r in others.orderBy(F.desc("n"), "shape", "tag").limit(max_words).collect():
        shapes.setdefault(r["shape"], {})[r["tag"]] = r["n"]
    # shapes that stand for names never seen: how often a name's word was seen only once
    once = n.where(f"kind = 'e' AND tag <> {O} AND n = 1").groupBy("shape", "tag").agg(F.sum("n").alias("n"))
    for r in once.orderBy(F.desc("n"), "shape", "tag").limit(max_words).collect():
        shapes.setdefault(r["shape"], {})[r["tag"]] = shapes.get(r["shape"], {}).get(r["tag"], 0) + r["n"]
    return Tagger(steps, words, shapes)
