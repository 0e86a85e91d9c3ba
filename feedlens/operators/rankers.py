"""Extractive sentence rankers (T19) in the array domain of one text.

A ranker is a Column function: the words of a text's sentences (an array per sentence) in, the
sentences' scores (an array) out. Words are only ever compared with words of the same text, so
texts are grouped once, where copies of a text become one row, and nothing is shuffled, staged
or written after that, however many rounds a ranker runs.

Inside a text the term-sentence matrix is held by its two sides: for every word the sentences
that hold it, for every sentence its words. Both come from one sorted list of (word, sentence)
cut into runs; a product with the matrix sums over one side, then over the other. That is
linear in the text's words (sorting aside).

* ``luhn``: words that the text repeats are significant; sig^2 / words.
* ``textrank``: links weigh common words / (log(1 + |a|) + log(1 + |b|)), a walk with damping.
  Links are never formed: a word's weight towards a sentence depends only on the sizes of the
  sentences that hold it, so one sum per (word, size) stands for all of them.
* ``lexrank``: links join sentences whose tf-idf cosine is 0.1 or more; the cosines are summed
  for one sentence at a time, only the links are kept.
* ``lsa``: the ``TOPICS`` leading right singular vectors of the term-sentence matrix by
  subspace iteration; a sentence's score is its length in that space.

Walks run ``ROUNDS`` rounds and subspaces ``LSA_ROUNDS``: fixed numbers, so results do not
depend on when a document is considered to have converged. Scores are rounded to
``DIGITS`` places before sentences are ordered, equal ones by position.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col_
from ..session import cut_lineage
from .mentions import sentences
from .scoring import TOKEN_SPLIT

# Function words left out of sentence scoring (our list; the ranking is our own
# re-statement of the classic methods, not a copy of any library's).
STOP_WORDS = ("a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "at", "by", "for", "with",
              "from", "as", "is", "are", "was", "were", "be", "been", "it", "its", "this", "that",
              "these", "those", "he", "she", "they", "we", "you", "i", "not", "no", "so", "if", "than")

DAMPING = 0.85
ROUNDS = 10
LEXRANK_COSINE = 0.1
TOPICS = 3             # singular vectors (the sums below are written out for three)
LSA_ROUNDS = 5
DIGITS = 6
RANK_EPS = 1e-10       # a direction with less of its length left has none of its own


def text_key(text) -> Column:
    return F.unhex(F.md5(col_(text)))


def text_rows(texts: DataFrame, text_col: str) -> DataFrame:
    """key, sentences, terms (per sentence the 64-bit hashes of its lower-cased words without
    function words) of each distinct text."""
    one = texts.groupBy(text_key(text_col).alias("key")).agg(F.first(text_col).alias("text"))

    def terms(sentence) -> Column:
        words = F.filter(F.split(F.lower(sentence), TOKEN_SPLIT), lambda t: (t != "") & ~t.isin(*STOP_WORDS))
        return F.transform(words, lambda t: F.xxhash64(t))
    d = one.select("key", sentences("text").alias("sentences"))
    return d.withColumn("terms", let(F.col("sentences"), lambda x: F.transform(x, terms)))


def sentence_rows(texts: DataFrame, text_col: str) -> DataFrame:
    """key, g (number of the text), k, sentence, terms of each sentence of each distinct text,
    checkpointed."""
    d = text_rows(texts, text_col).withColumn("g", F.monotonically_increasing_id())
    rows = d.select("key", "g", F.posexplode_outer(F.arrays_zip("sentences", "terms")).alias("k", "s"))
    return cut_lineage(rows.select("key", "g", "k", F.col("s.sentences").alias("sentence"), F.col("s.terms").alias("terms")))


def incidences(sents: DataFrame) -> DataFrame:
    """g, k, term, tf."""
    return sents.select("g", "k", F.explode("terms").alias("term")).groupBy("g", "k", "term").agg(F.count(F.lit(1)).alias("tf"))


# --- arrays of one text ------------------------------------------------------------------

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once (as an expression it would be worked out
    anew wherever a lambda names it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def total(values: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + of(v))


def runs(rows: Column, by: str, of: Callable[[Column], Column]) -> Column:
    """Sorted structs cut where the field ``by`` changes: an array of ``of(struct)`` per run."""
    def cut(r: Column) -> Column:
        starts = F.filter(F.transform(r, lambda x, i: F.when((i == 0) | (x[by] != F.get(r, i - 1)[by]), i + 1)), lambda i: i.isNotNull())
        return let(starts, lambda at: F.transform(at, lambda a, i: F.transform(
            F.slice(r, a, F.coalesce(F.get(at, i + 1), F.size(r) + 1) - a), of)))
    return let(rows, cut)


def by_word(terms: Column, of: Callable[[Column], Column]) -> Column:
    """For every word of a text its places (sentence ``k``, as often as it is there)."""
    places = F.flatten(F.transform(terms, lambda ts, k: F.transform(ts, lambda t: F.struct(t.alias("t"), k.alias("k")))))
    return runs(F.sort_array(places), "t", of)


def by_sentence(entries: Column, sents: Column) -> Column:
    """``entries`` (structs whose first field is ``k``, the second ``t``, 0 or more) dealt to the
    sentences they belong to; sentences without any have an empty array. ``sents``: an array of
    the text's sentences; ``t`` -1 holds each one's place among the sorted entries."""
    def deal(e: Column) -> Column:
        return F.transform(runs(F.sort_array(e), "k", lambda x: x), lambda r: F.slice(r, 2, F.size(r)))
    return deal(F.concat(entries, sents))


def luhn_scores(terms: Column) -> Column:
    def scores(often: Column, ts: Column) -> Column:
        rows = by_sentence(F.flatten(F.transform(often, lambda ks, t: F.transform(ks, lambda k: F.struct(k.alias("k"), t.alias("t"))))),
                           F.transform(ts, lambda _, k: F.struct(k.alias("k"), F.lit(-1).alias("t"))))

        def score(row: Column) -> Column:
            sig = F.size(F.filter(row, lambda e: F.size(F.get(often, e["t"])) >= 2)).cast("long")
            return F.when(F.size(row) > 0, sig * sig / F.size(row))
        return F.transform(rows, score)
    return let(terms, lambda ts: let(by_word(ts, lambda p: p["k"]), lambda often: scores(often, ts)))


def walk(start: Column, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda score, _: step(score))


def textrank_scores(terms: Column) -> Column:
    def log_size(ts: Column) -> Column:
        return F.log(F.lit(1.0) + F.size(ts))

    def ranked(ts: Column, words: Column, rows: Column, sizes: Column) -> Column:
        def linked(x: Column) -> Column:
            """For every sentence the sum of its links' weights times x at their other end; what
            it gets by the link to itself is taken off."""
            sums = F.transform(words, lambda groups: F.transform(groups, lambda ks: F.struct(
                F.get(sizes, F.get(ks, F.lit(0))).alias("l"), total(ks, lambda k: F.get(x, k)).alias("s"))))

            def of(z: Column) -> Column:
                def got(row: Column, k: Column) -> Column:
                    own = F.get(sizes, k)
                    f = F.aggregate(row, F.lit(0.0), lambda a, e: F.aggregate(F.get(z, e["t"]), a, lambda b, g: b + g["s"] / (g["l"] + own)))
                    return F.when(F.size(row) > 0, f - F.get(x, k) * F.size(row) / (2 * own)).otherwise(0.0)
                return F.transform(rows, got)
            return let(sums, of)

        def rounds(row: Column) -> Column:
            def step(score: Column) -> Column:
                # a sentence with no word in common with others keeps rounding noise of its own weight
                x = F.zip_with(score, row, lambda s, w: F.when(w > 1e-9, s / w).otherwise(0.0))
                return let(x, lambda x: F.transform(linked(x), lambda f: F.lit(1 - DAMPING) + DAMPING * f))
            return walk(F.transform(row, lambda _: F.lit(1.0)), step)
        scores = let(linked_ones(linked, ts), rounds)
        return F.zip_with(scores, ts, lambda s, t: F.when(F.size(t) > 0, s))

    def linked_ones(linked, ts: Column) -> Column:
        return let(F.transform(ts, lambda _: F.lit(1.0)), linked)

    def sides(ts: Column) -> Column:
        """The places of a word by the sizes of the sentences that hold it."""
        places = F.flatten(F.transform(ts, lambda t, k: F.transform(t, lambda w: F.struct(w.alias("t"), F.size(t).alias("a"), k.alias("k")))))
        words = F.transform(runs(F.sort_array(places), "t", lambda p: p), lambda r: runs(r, "a", lambda p: p["k"]))

        def of(words: Column) -> Column:
            rows = by_sentence(F.flatten(F.transform(words, lambda g, t: F.transform(F.flatten(g), lambda k: F.struct(k.alias("k"), t.alias("t"))))),
                               F.transform(ts, lambda _, k: F.struct(k.alias("k"), F.lit(-1).alias("t"))))
            return let(rows, lambda rows: let(F.transform(ts, log_size), lambda sizes: ranked(ts, words, rows, sizes)))
        return let(words, of)
    return let(F.transform(terms, lambda t: F.array_distinct(t)), sides)


def cosines(terms: Column) -> Column:
    """For every sentence i of a text the sentences j > i whose tf-idf cosine with it is
    ``LEXRANK_COSINE`` or more."""
    def weights(ts: Column) -> Column:
        def of(ks: Column, t: Column) -> Column:
            """(k, t, w) of one word: ``ks`` are its places, one array per sentence."""
            idf = F.log(F.size(ts) / (1 + F.size(ks))) + 1
            return let(idf, lambda idf: F.transform(ks, lambda same: F.struct(
                F.get(same, F.lit(0)).alias("k"), t.alias("t"), (F.size(same) * idf).alias("w"))))
        entries = F.flatten(F.transform(by_word(ts, lambda p: p), lambda r, t: let(runs(r, "k", lambda p: p["k"]), lambda ks: of(ks, t))))
        rows = by_sentence(entries, F.transform(ts, lambda _, k: F.struct(k.alias("k"), F.lit(-1).alias("t"), F.lit(0.0).alias("w"))))
        return F.transform(rows, lambda row: let(F.sqrt(total(row, lambda e: e["w"] * e["w"])), lambda norm: F.transform(
            row, lambda e: F.struct(e["t"].alias("t"), e["k"].alias("k"), (e["w"] / norm).alias("w")))))

    def links(rows: Column) -> Column:
        def of(words: Column) -> Column:
            def nearby(row: Column, i: Column) -> Column:
                parts = F.flatten(F.transform(row, lambda e: F.transform(
                    F.filter(F.get(words, e["t"]), lambda p: p["k"] > i),
                    lambda p: F.struct(p["k"].alias("k"), (e["w"] * p["w"]).alias("w")))))
                dots = F.transform(runs(F.sort_array(parts), "k", lambda p: p), lambda r: F.struct(
                    F.get(r, F.lit(0))["k"].alias("k"), total(r, lambda p: p["w"]).alias("dot")))
                return F.transform(F.filter(dots, lambda d: F.round(d["dot"], 9) >= LEXRANK_COSINE), lambda d: d["k"])
            return F.transform(rows, nearby)
        return let(runs(F.sort_array(F.flatten(rows)), "t", lambda e: e), of)
    return let(terms, lambda ts: let(weights(ts), links))


def cosine_links(sents: DataFrame) -> DataFrame:
    """g, i, j (i < j) of sentences whose tf-idf cosine is ``LEXRANK_COSINE`` or more."""
    d = of_texts(sents).withColumn("_l", cosines(F.col("terms")))
    d = d.select("g", F.posexplode_outer("_l").alias("i", "js"))
    return d.select("g", "i", F.explode_outer("js").alias("j")).where(F.col("j").isNotNull())


def lexrank_scores(terms: Column) -> Column:
    def ranked(ts: Column, links: Column) -> Column:
        # links both ways; a sentence with words is like itself
        ends = F.flatten(F.transform(links, lambda js, i: F.flatten(F.transform(js, lambda j: F.array(
            F.struct(i.alias("k"), j.alias("t")), F.struct(j.alias("k"), i.alias("t")))))))
        own = F.transform(F.filter(F.transform(ts, lambda t, k: F.when(F.size(t) > 0, k)), lambda k: k.isNotNull()),
                          lambda k: F.struct(k.alias("k"), k.alias("t")))
        near = by_sentence(F.concat(ends, own), F.transform(ts, lambda _, k: F.struct(k.alias("k"), F.lit(-1).alias("t"))))

        def rounds(near: Column) -> Column:
            def step(score: Column) -> Column:
                x = F.zip_with(score, near, lambda s, n: F.when(F.size(n) > 0, s / F.size(n)).otherwise(0.0))
                return let(x, lambda x: F.transform(near, lambda n: F.lit(1 - DAMPING) + DAMPING * total(n, lambda e: F.get(x, e["t"]))))
            return walk(F.transform(near, lambda _: F.lit(1.0)), step)
        return let(near, rounds)
    return let(terms, lambda ts: let(cosines(ts), lambda links: ranked(ts, links)))


def lsa_start(k, c: int):
    """Entry of the c-th (from 1) start vector for sentence k."""
    return F.cos((k + 1) * F.lit(float(c)))


def lsa_scores(terms: Column) -> Column:
    topics = range(TOPICS)

    def ranked(ts: Column, words: Column, rows: Column) -> Column:
        def product(v: Column) -> Column:
            """The term-sentence matrix and its transpose applied to v."""
            return let(F.transform(words, lambda ks: total(ks, lambda k: F.get(v, k))),
                       lambda z: F.transform(rows, lambda row: total(row, lambda e: F.get(z, e["t"]))))

        def dot(a: Column, b: Column) -> Column:
            return total(F.zip_with(a, b, lambda x, y: x * y), lambda p: p)

        def inverse(d: Column, whole: Column) -> Column:
            return F.when(d > RANK_EPS * whole, 1 / F.sqrt(d)).otherwise(0.0)

        def orthonormal(y: Column) -> Column:
            """Gram-Schmidt by the Cholesky factor of the vectors' products."""
            at = [F.get(y, F.lit(c)) for c in topics]
            g = let(F.array(*[dot(at[a], at[b]) for a in topics for b in topics if a <= b]), factor)
            return let(g, lambda f: F.array(*_basis(at, f)))

        def factor(g: Column) -> Column:
            """i1, r12, r13, i2, r23, i3 of g11, g12, g13, g22, g23, g33."""
            g11, g12, g13, g22, g23, g33 = (F.get(g, F.lit(c)) for c in range(6))
            one = let(inverse(g11, F.lit(0.0)), lambda i: F.array(i, g12 * i, g13 * i))

            def two(a: Column) -> Column:
                _, r12, r13 = (F.get(a, F.lit(c)) for c in topics)
                return let(inverse(g22 - r12 * r12, g22), lambda i: F.concat(a, F.array(i, (g23 - r12 * r13) * i)))

            def three(a: Column) -> Column:
                r13, r23 = F.get(a, F.lit(2)), F.get(a, F.lit(4))
                return F.concat(a, F.array(inverse(g33 - r13 * r13 - r23 * r23, g33)))
            return let(let(one, two), three)

        def rounds() -> Column:
            def vector(c: int) -> Column:
                return F.transform(ts, lambda _, k: lsa_start(k, c + 1))
            start = F.array(*[vector(c) for c in topics])
            return F.aggregate(F.sequence(F.lit(1), F.lit(LSA_ROUNDS)), start, lambda q, _: let(F.transform(q, product), orthonormal))

        def lengths(q: Column) -> Column:
            part = [F.zip_with(F.get(q, F.lit(c)), product(F.get(q, F.lit(c))), lambda a, b: a * b) for c in topics]
            return let(F.array(*part), lambda p: F.transform(ts, lambda t, k: F.when(F.size(t) > 0, F.sqrt(
                F.greatest(F.lit(0.0), sum((F.get(F.get(p, F.lit(c)), k) for c in topics), F.lit(0.0)))))))
        return let(rounds(), lengths)

    def _basis(y: list[Column], f: Column) -> list[Column]:
        i1, r12, r13, i2, r23, i3 = (F.get(f, F.lit(c)) for c in range(6))
        q1 = F.transform(y[0], lambda v: v * i1)
        q2 = F.zip_with(y[1], y[0], lambda v, a: (v - r12 * (a * i1)) * i2)
        q3 = F.zip_with(y[2], F.zip_with(y[0], y[1], lambda a, b: F.struct((a * i1).alias("a"), ((b - r12 * (a * i1)) * i2).alias("b"))),
                        lambda v, q: (v - r13 * q["a"] - r23 * q["b"]) * i3)
        return [q1, q2, q3]

    def sides(ts: Column, words: Column) -> Column:
        rows = by_sentence(F.flatten(F.transform(words, lambda ks, t: F.transform(ks, lambda k: F.struct(k.alias("k"), t.alias("t"))))),
                           F.transform(ts, lambda _, k: F.struct(k.alias("k"), F.lit(-1).alias("t"))))
        return let(rows, lambda rows: ranked(ts, words, rows))
    return let(terms, lambda ts: let(by_word(ts, lambda p: p["k"]), lambda words: sides(ts, words)))


SCORES: dict[str, Callable[[Column], Column]] = {"luhn": luhn_scores, "textrank": textrank_scores, "lexrank": lexrank_scores, "lsa": lsa_scores}


def scored(terms: Column, algorithm: str) -> Column:
    """Scores of a text's sentences, null for those without words; null where none has any."""
    return F.when(F.exists(terms, lambda t: F.size(t) > 0), SCORES[algorithm](terms))


def of_texts(sents: DataFrame) -> DataFrame:
    """g, terms (per sentence, in order) of sentence rows."""
    d = sents.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "terms"))).alias("s"))
    return d.select("g", F.transform("s", lambda x: x["terms"]).alias("terms"))


def ranker(algorithm: str) -> Callable[[DataFrame], DataFrame]:
    """A ranker over sentence rows: (g, k, score) of the sentences with words."""
    def rank(sents: DataFrame) -> DataFrame:
        d = of_texts(sents).withColumn("_s", scored(F.col("terms"), algorithm))
        return d.select("g", F.posexplode_outer("_s").alias("k", "score")).where(F.col("score").isNotNull())
    return rank


RANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {a: ranker(a) for a in SCORES}
luhn, textrank, lexrank, lsa = RANKERS.values()


def best_sentences(texts: DataFrame, algorithm: str, n: int) -> DataFrame:
    """key, best: the ``n`` sentences of highest score (ties: earlier first; no score counts
    as zero) of each of the ``text_rows``, joined in the text's order. Null without any word."""
    def best(scores: Column) -> Column:
        order = F.sort_array(F.transform(scores, lambda s, k: F.struct((-F.round(F.coalesce(s, F.lit(0.0)), DIGITS)).alias("s"), k.alias("k"))))
        top = F.sort_array(F.transform(F.slice(order, 1, n), lambda o: o["k"]))
        return let(F.col("sentences"), lambda x: F.array_join(F.transform(top, lambda k: F.get(x, k)), " "))
    return texts.select("key", let(scored(F.col("terms"), algorithm), lambda s: F.when(s.isNotNull(), best(s))).alias("best"))
