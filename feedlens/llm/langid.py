"""Language ID by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs (seeded by its code point). An n-gram's
vector binds its letters: the elementwise product of the letter vectors, each permuted
(rotated) by its place. A text's vector bundles (sums) the vectors of its n-grams; a
language's prototype bundles the n-grams of all its training texts, less the mean of all
prototypes' directions, so that what languages share doesn't blur them. The language whose
prototype has the largest cosine wins; its share of a softmax over the cosines is the score.

Texts are lower-cased; whatever is no letter counts as a space, runs of spaces as one.
Learning counts n-grams per language in every task and bundles them there, so one vector
per language and task is shuffled; prototypes are (languages x DIM) numbers, checked
against ``MAX_LANGUAGES`` before they reach the driver.

Defined cases: null text and text without letters: ``und``, score 0; with nothing learned
every text is ``und``; ties between languages go to the smaller name; rows with null lang
teach nothing; empty tables give no rows; repeated rows count as often as they occur; a very
long text is read whole, one at a time; other columns are never read (``predict`` adds
``lang_pred`` and ``score``, which its input must not hold).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, extended, texts_of

DIM = 1024
NGRAM = 3
SEED = 2024
SHARPNESS = 12.0
MAX_LANGUAGES = 2000
MAX_SCRIPTS = 1000   # more than first words of letters' names
# Limits of the language stage, by whole held-out documents of sf0.1 with SHORT distinct
# n-grams or more (lowest centred cosine 0.106, lowest cosine 0.22) and by Finnish, Italian,
# Indonesian and Polish sentences and random letters (centred 0.085, cosine 0.20 at most).
MIN_CENTRED = 0.1    # cosine to the best prototype, both less the prototypes' mean
MIN_ALONE = 0.2      # the same, when one language is learned and there is no mean to take off
NEAR = 0.5           # plain cosine of a text that is known however alike the languages are
SHORT = 48           # distinct n-grams; below, cosines tell nothing
UNKNOWN = "und"
SPACE = 32
NOT_LETTERS = re.compile(r"[\W\d_]+")  # letters are word characters but digits and "_"


@lru_cache(maxsize=1 << 14)
def placed(code: int, place: int) -> np.ndarray:
    """A letter's vector, rotated by its place from the end of the n-gram."""
    signs = np.random.default_rng([SEED, code]).integers(0, 2, DIM).astype(np.int8) * 2 - 1
    return np.roll(signs, place)


class NGrams:
    """Vectors of the n-grams that this worker has met, ``limit`` of them at most at a time
    (32 MB): beyond that it starts anew."""

    def __init__(self, limit: int = 1 << 15):
        self.limit, self.rows, self.table = limit, {}, np.empty((1 << 12, DIM), dtype=np.int8)

    def at(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of distinct n-gram codes (see ``grams``), one row each."""
        listed = codes.tolist()
        new = [c for c in listed if c not in self.rows]
        if len(new) + len(self.rows) > self.limit:
            self.rows, new = {}, listed
        if len(new) + len(self.rows) > len(self.table):
            bigger = np.empty((min(self.limit, 2 * (len(new) + len(self.rows))), DIM), dtype=np.int8)
            bigger[:len(self.rows)] = self.table[:len(self.rows)]
            self.table = bigger
        for code in new:
            row = self.rows[code] = len(self.rows)
            bound = np.ones(DIM, dtype=np.int8)
            for place in range(NGRAM):
                bound *= placed((code >> (21 * place)) & 0x1FFFFF, place)
            self.table[row] = bound
        return self.table[[self.rows[c] for c in listed]]


_GRAMS = NGrams()


def grams(text: bytes) -> np.ndarray:
    """n-gram codes of a text, 21 bits for each letter; empty if it has no letter."""
    s = NOT_LETTERS.sub(" ", text.decode().lower()).strip(" ")
    if not any(map(str.isalpha, s)):
        return np.empty(0, dtype=np.int64)
    cp = np.frombuffer(f" {s} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    out = cp[:len(cp) - NGRAM + 1].copy()
    for k in range(1, NGRAM):
        out = (out << 21) | cp[k:len(cp) - NGRAM + 1 + k]
    return out


def bundle(codes: np.ndarray, step: int = 2048) -> np.ndarray:
    """Sum of the vectors of n-grams, with repeats."""
    kinds, n = np.unique(codes, return_counts=True)
    total = np.zeros(DIM, dtype=np.float64)
    for at in range(0, len(kinds), step):
        total += n[at:at + step].astype(np.float32) @ _GRAMS.at(kinds[at:at + step]).astype(np.float32)
    return total


@lru_cache(maxsize=1 << 16)
def script(code: int) -> str:
    """A letter's script, as its Unicode name begins."""
    return unicodedata.name(chr(code), "").split(" ")[0]


def scripts_of(codes: np.ndarray) -> dict[str, int]:
    """Letters of each script in a text's ``grams`` (every letter is the middle of one)."""
    letters, n = np.unique((codes >> 21) & 0x1FFFFF, return_counts=True)
    out: dict[str, int] = {}
    for code, k in zip(letters.tolist(), n.tolist()):
        if code != SPACE:
            out[script(code)] = out.get(script(code), 0) + k
    return out


def train(docs: DataFrame, scripts: set[str] | None = None) -> dict[str, np.ndarray]:
    """Prototype of each language in ``docs`` (text, lang), from all its texts; their scripts
    are added to ``scripts``, if it is given."""
    with_scripts = scripts is not None

    def run(batches: Iterator[pa.RecordBatch]):
        total: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts_of(b), b.column(b.schema.get_field_index("lang")).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, codes in by.items():
                joined = np.concatenate(codes)
                total["L" + lang] = total.get("L" + lang, 0) + bundle(joined)
                if with_scripts:
                    total |= {"S" + x: np.ones(1) for x in scripts_of(joined)}
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()],
                                                                              pa.list_(pa.float64()))], ["lang", "v"])

    parts = docs.select("text", "lang").where(F.col("lang").isNotNull()).mapInArrow(run, "lang string, v array<double>")
    sums = (parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
            .select("lang", F.transform("v", lambda p: p["x"]).alias("v")))
    got = sums.limit(MAX_LANGUAGES + MAX_SCRIPTS + 1).collect()
    if sum(r["lang"][0] == "L" for r in got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if with_scripts:
        scripts |= {r["lang"][1:] for r in got if r["lang"][0] == "S"}
    return {r["lang"][1:]: np.array(r["v"]) for r in sorted(got, key=lambda r: r["lang"]) if r["lang"][0] == "L" and np.any(r["v"])}


def nearest(prototypes: dict[str, np.ndarray]):
    """n-gram codes -> (centred cosine to each prototype, largest plain cosine); None if there
    is nothing to compare."""
    names = list(prototypes)
    if names:
        unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n]) for n in names])
        centre = unit.mean(axis=0) * (len(names) > 1)
        own = unit - centre
        own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)

    def compare(codes: np.ndarray) -> tuple[np.ndarray, float] | None:
        v = bundle(codes) if len(codes) and names else None
        size = np.linalg.norm(v) if v is not None else 0.0
        if not size:
            return None
        v = v / size
        off = v - centre
        return own @ off / max(np.linalg.norm(off), 1e-12), float((unit @ v).max())
    return compare


def classifier(prototypes: dict[str, np.ndarray]):
    """texts -> (languages, scores)."""
    names, compare = list(prototypes), nearest(prototypes)

    def predict(texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for t in texts:
            got = compare(grams(t))
            if got is None:
                langs.append(UNKNOWN), scores.append(0.0)
                continue
            cos = got[0]
            e = np.exp(SHARPNESS * (cos - cos.max()))
            best = int(cos.argmax())
            langs.append(names[best]), scores.append(float(e[best] / e.sum()))
        return langs, scores
    return predict


def recogniser(prototypes: dict[str, np.ndarray], scripts: set[str]):
    """text -> whether it is in a learned language: short texts (by distinct n-grams, so
    repeats add nothing) if at least half of their letters are in learned scripts, others by
    their cosines. With nothing learned, any text with letters."""
    compare = nearest(prototypes)
    limit = MIN_CENTRED if len(prototypes) > 1 else MIN_ALONE

    def known(text: bytes) -> bool:
        codes = grams(text)
        if not len(codes) or not prototypes:
            return len(codes) > 0
        if len(np.unique(codes)) < SHORT:
            of = scripts_of(codes)
            return 2 * sum(n for x, n in of.items() if x in scripts) >= sum(of.values())
        got = compare(codes)
        return got is not None and bool(got[0].max() >= limit or got[1] >= NEAR)
    return known


def held_out(modulus: int = 3, fold: int = 1, c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % modulus == fold, F.lit(False))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` and the named columns: language, score."""
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores = classifier(prototypes)(texts_of(batch))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                                          [*batch.schema.names, lang_pred, score])
    return arrow_map(docs, run, extended(docs.schema, **{lang_pred: "string", score: "double"}))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that aren't held out."""
    d = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = train(d.where(~F.col("held_out")))
    return predict(d.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_language(docs: DataFrame) -> DataFrame:
    """The documents whose language is known (see ``recogniser``); rejected are texts without
    letters, short texts in other scripts and longer ones unlike every learned language.
    It learns from every row with text and lang (``held_out`` is for ``identify`` alone).
    Columns as in ``docs``."""
    scripts: set[str] = set()
    prototypes = train(docs, scripts)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = recogniser(prototypes, scripts)
        return batch.filter(pa.array([known(t) for t in texts_of(batch)], pa.bool_()))
    return arrow_map(docs, run, docs.schema)
