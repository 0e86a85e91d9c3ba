"""Company mention extraction and analysis.

Everything per text is done in the array domain of one row — regex matches, the
gaps between them, sentence spans — and only the final (match, offsets, context)
tuples are exploded, so no text is copied per mention and nothing shuffles until
the dedup aggregate. The alias dictionary is a literal regex/map (32 entries).
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import WS_RUN, col_, strip_ws, stripped_length_at_least
from ..session import cut_lineage
from ..sources import dims
from . import dedup, scoring

SENTENCE_SPLIT = r"(?<=[.!?])" + WS_RUN
SENTENCE_SEP = r"[.!?](" + WS_RUN + ")"  # same runs as the look-behind split, scanned faster
ALIAS_REGEX = "(?iU)" + dims.alias_trie_pattern()  # same matches as the flat alternation
ENTITY_LABELS = ("company", "organization", "COMPANY", "ORGANIZATION", "ORG")


def sentences(text) -> Column:
    """T5: split after . ! ? followed by whitespace."""
    return F.split(col_(text), SENTENCE_SPLIT, -1)


BLOCK = 256  # array elements per block: keeps the work per text linear in its length


def _running(lengths: Column, start: Column) -> Column:
    """[start, start+l0, start+l0+l1, ...] (same size as ``lengths``, short arrays only)."""
    init = F.struct(F.array().cast("array<long>").alias("a"), start.cast("long").alias("s"))
    return F.aggregate(lengths, init,
                       lambda acc, x: F.struct(F.array_append(acc["a"], acc["s"]).alias("a"),
                                               (acc["s"] + x).alias("s")),
                       lambda acc: acc["a"])


def with_prefix(df: DataFrame, lengths: Column, into: str) -> DataFrame:
    """Adds ``into`` = [0, l0, l0+l1, ...], block by block: an append copies its array, so
    running sums are built over blocks of ``BLOCK`` lengths and shifted by the blocks before.

    Each stage is its own projection and every staged array is named twice by its consumer:
    Catalyst then keeps the projection instead of inlining it into a lambda."""
    d = df.withColumn("_len", lengths)
    n = F.greatest(F.ceil(F.size("_len") / BLOCK).cast("int"), F.lit(1))
    d = d.withColumn("_blk", F.transform(F.sequence(F.lit(0), n - 1),
                                         lambda b: F.slice(F.col("_len"), b * BLOCK + 1, F.lit(BLOCK))))
    sums = F.transform("_blk", lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v))
    d = d.withColumn("_at", _running(sums, F.lit(0)))
    return d.withColumn(into, F.flatten(F.zip_with("_blk", "_at", _running))).drop("_len", "_blk", "_at")


def with_sentences(df: DataFrame, text_col: str, compat: bool = False, only_if: Column | None = None) -> DataFrame:
    """Adds ``_sents`` and ``_starts`` (start offset of each sentence). With ``compat`` every
    separator counts as one character, as in the service's walk, which drifts after wider
    gaps. With ``only_if`` the sentence scans run only on rows where it holds."""
    def gate(c):
        return c if only_if is None else F.when(only_if, c)
    df = df.withColumn("_sents", gate(sentences(text_col)))
    if compat:
        return with_prefix(df, F.transform("_sents", lambda s: F.length(s).cast("long") + 1), "_starts")
    df = df.withColumn("_seps", gate(F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_SEP), 1)))
    lens = F.zip_with("_sents", "_seps", lambda s, p: F.length(s).cast("long")
                      + F.coalesce(F.length(p).cast("long"), F.lit(0).cast("long")))
    return with_prefix(df, lens, "_starts").drop("_seps")


def with_contexts(df: DataFrame, text: str, matches: str, mstarts: str, into: str) -> DataFrame:
    """T6 for every match of a text at once: adds an array of (matched_text, start_char,
    end_char, context_sentence), in match order, from ``_sents`` and ``_starts``.

    A match's sentence is the last one that starts at or before it, found in the starts of
    every ``BLOCK``-th sentence first and then inside one block. The containing sentence is
    returned stripped; when the match lies behind its end (``compat`` drift) the text around
    the match (100 chars each side) is used, as the service does."""
    d = df.withColumn("_coarse", F.filter("_starts", lambda x, i: i % BLOCK == 0))

    def spot(m, p):
        upto = F.least(F.size(F.filter("_coarse", lambda c: c <= p)), F.size("_coarse"))
        lo = (F.greatest(upto, F.lit(1)) - 1) * BLOCK
        k = F.least(lo + F.size(F.filter(F.slice(F.col("_starts"), lo + 1, F.lit(BLOCK)), lambda x: x <= p)), F.size("_starts"))
        return F.struct(m.alias("matched_text"), p.alias("start_char"), (p + F.length(m)).cast("long").alias("end_char"),
                        k.cast("int").alias("k"))

    d = d.withColumn("_spots", F.zip_with(matches, mstarts, spot))
    t = F.col(text)

    def ctx(o):
        # (both arrays are read twice: for the sentence and for where it ends)
        sent, start = F.get(F.col("_sents"), o["k"] - 1), F.get(F.col("_starts"), o["k"] - 1)
        inside = (o["k"] > 0) & (o["start_char"] < start + F.length(sent))
        lo = F.greatest(o["start_char"] - 100, F.lit(0))
        window = F.substring(t, (lo + 1).cast("int"), (o["end_char"] + 100 - lo).cast("int"))
        return F.left(F.when((F.size("_starts") > 0) & inside, strip_ws(sent)).otherwise(strip_ws(window)),
                      F.lit(dims.CONTEXT_MAX_CHARS))

    return d.withColumn(into, F.transform("_spots", lambda o: F.struct(
        o["matched_text"].alias("matched_text"), o["start_char"].alias("start_char"),
        o["end_char"].alias("end_char"), ctx(o).alias("context_sentence")))).drop("_coarse", "_spots")


def with_match_starts(df: DataFrame, matches: str, gaps: str, into: str) -> DataFrame:
    """Adds the start offset of every alias match: running length of the gaps and matches
    before it (the gaps are ``split`` on the same pattern)."""
    steps = F.zip_with(gaps, matches, lambda g, m: F.length(g).cast("long")
                       + F.coalesce(F.length(m).cast("long"), F.lit(0).cast("long")))
    d = with_prefix(df, steps, "_before")
    starts = F.zip_with("_before", gaps, lambda b, g: b + F.length(g).cast("long"))
    return d.withColumn(into, F.slice(starts, 1, F.size(matches))).drop("_before")


# Characters outside ASCII whose simple case mapping lands on an ASCII letter; with them
# present a case-insensitive match can hide from a lowercase substring test.
_FOLDING = r"[\x{17F}\x{212A}\x{130}\x{131}]"


def alias_anchors() -> list[str]:
    """Substrings of which every regex alias contains one (lowercase)."""
    out: list[str] = []
    for a in sorted(dims.regex_aliases(), key=len):
        if not any(x in a for x in out):
            out.append(a)
    return out


def may_mention(text: Column) -> Column:
    """Cheap exact prefilter: a text can hold an alias match only if its lowercase
    form contains one of the anchors (or it has one of the few case-folding
    characters, then the full regex decides)."""
    low = F.lower(text)
    cond = text.rlike(_FOLDING)
    for a in alias_anchors():
        cond = cond | (F.instr(low, a) > 0)
    return F.coalesce(cond, F.lit(False))


def regex_mentions(df: DataFrame, text_col: str = "text", id_col: str = "article_id",
                   compat: bool = False, prefilter: bool = False) -> DataFrame:
    """Alias regex (longest first, case-insensitive, word-bounded, ambiguous
    aliases excluded), non-overlapping, with offsets, context and confidence 0.9.

    Per text: two linear regex scans (matches, and the gaps between them), the sentence
    split, block-wise offsets; then one explode of the small per-mention structs, so the
    text is never copied per mention and nothing shuffles."""
    d = df.select(F.col(id_col), F.col(text_col).alias("_t"))
    if prefilter:  # pays off when few texts name a tracked company (measured: ~half a regex pass)
        d = d.where(may_mention(F.col("_t")))
    d = (d.withColumn("_ms", F.regexp_extract_all(F.col("_t"), F.lit(ALIAS_REGEX), 1))
         .withColumn("_gs", F.when(F.size("_ms") > 0, F.split(F.col("_t"), ALIAS_REGEX, -1))))
    d = with_match_starts(d, "_ms", "_gs", "_mst").drop("_gs")
    # texts without a match produce no rows: skip their gap and sentence scans
    d = with_sentences(d, "_t", compat, only_if=F.size("_ms") > 0)
    d = with_contexts(d, "_t", "_ms", "_mst", "_rows")
    # (outer: otherwise Catalyst infers a "not empty" filter and pushes all of this into the scan)
    out = d.select(F.col(id_col), F.posexplode_outer("_rows").alias("pos", "m")).where(F.col("pos").isNotNull())
    info = F.try_element_at(dims.alias_map_expr(), F.lower(strip_ws(F.col("m.matched_text"))))
    return (out.select(F.col(id_col), info["name"].alias("company_name"), info["ticker"].alias("ticker"),
                       "m.matched_text", F.col("m.start_char").cast("long").alias("start_char"),
                       F.col("m.end_char").cast("long").alias("end_char"),
                       F.lit(dims.MENTION_REGEX_CONFIDENCE).alias("confidence"), "m.context_sentence")
            .where(F.col("ticker").isNotNull()))


ENTITY_SCHEMA = T.StructType([
    T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()),
    T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType()),
])


def _windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int, int]]:
    """(offset, window, first, last): consecutive windows of a text that overlap; spans that
    start in [first, last) are taken from this window, so every place counts once."""
    step = size - overlap
    for at in range(0, max(1, len(text) - overlap), step):
        last = at + size >= len(text)
        yield at, text[at:at + size], at + (overlap // 2 if at else 0), len(text) if last else at + step + overlap // 2


def with_model_spans(df: DataFrame, load_extractor: Callable[[], Callable[[str], list[dict]]], text_col: str,
                     into: str, max_chars: int = dims.MODEL_TEXT_MAX_CHARS, overlap: int = 500) -> DataFrame:
    """Adds the model's spans as an array of (start_char, end_char, label, score). The model
    sees windows of ``max_chars`` that overlap, so whole texts are read; a window that it
    fails on has no spans. A model with ``many(texts)`` gets the windows of a batch at once. Only
    offsets come back: the text stays where it is."""
    @F.pandas_udf(T.ArrayType(ENTITY_SCHEMA))
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = load_extractor()

        def found_in(windows: list[str]) -> Iterator[list[dict]]:
            if hasattr(extract, "many"):
                yield from extract.many(windows)
                return
            for window in windows:
                try:
                    yield extract(window)
                except Exception:  # noqa: BLE001  any failure of a plugged-in model
                    yield []

        for texts in batches:
            out: list[list[dict]] = [[] for _ in texts]
            places = [(row, *w) for row, text in enumerate(texts) if text is not None and len(text.strip()) >= 10
                      for w in _windows(text, max_chars, overlap)]
            for (row, at, _, first, last), found in zip(places, found_in([p[2] for p in places])):
                out[row] += [{"start_char": at + int(e["start_char"]), "end_char": at + int(e["end_char"]), "label": e.get("label"),
                              "score": e.get("score")} for e in found if first <= at + int(e["start_char"]) < last]
            yield pd.Series(out, index=texts.index, dtype=object)

    return df.withColumn(into, spans(F.col(text_col)))


def _model_rows(ex: DataFrame, id_col: str) -> DataFrame:
    """Mention rows from ``_t`` and ``ents``: label and alias filter, distinct spans, context."""
    amap = dims.alias_map_expr()

    def span(e):
        return F.substring(F.col("_t"), (e["start_char"] + 1).cast("int"),
                           (e["end_char"] - e["start_char"]).cast("int"))

    a = F.transform("ents", lambda e, i: F.struct(
        e["start_char"].alias("start_char"), e["end_char"].alias("end_char"), i.alias("pos"),
        e["label"].alias("label"),
        F.coalesce(e["score"], F.lit(dims.MENTION_MODEL_CONFIDENCE)).alias("confidence"),
        span(e).alias("matched_text")))
    a = F.filter(a, lambda x: x["label"].isin(*ENTITY_LABELS)
                 & F.try_element_at(amap, F.lower(strip_ws(x["matched_text"]))).isNotNull())
    ex = ex.withColumn("_srt", F.array_sort(a))  # by (start, end, position): first of each span run = first seen
    d = F.filter(F.zip_with("_srt", F.concat(F.array(F.lit(None)).cast(
        "array<struct<start_char:bigint,end_char:bigint,pos:int,label:string,confidence:double,matched_text:string>>"),
        F.col("_srt")), lambda x, p: F.when(p.isNull() | (p["start_char"] != x["start_char"])
                                   | (p["end_char"] != x["end_char"]), x)), lambda x: x.isNotNull())
    ex = ex.withColumn("_d", d)
    ex = (ex.withColumn("_ms", F.transform("_d", lambda x: x["matched_text"]))
          .withColumn("_mst", F.transform("_d", lambda x: x["start_char"])))
    ex = with_contexts(with_sentences(ex, "_t", only_if=F.size("_d") > 0), "_t", "_ms", "_mst", "_rows")
    g = ex.select(id_col, F.posexplode_outer(F.arrays_zip(F.col("_d").alias("sp"), F.col("_rows").alias("cx"))).alias("pos", "z"))
    g = g.where(F.col("pos").isNotNull())
    info = F.try_element_at(amap, F.lower(strip_ws(F.col("z.sp.matched_text"))))
    return g.select(id_col, info["name"].alias("company_name"), info["ticker"].alias("ticker"),
                    F.col("z.sp.matched_text").alias("matched_text"),
                    F.col("z.sp.start_char").alias("start_char"), F.col("z.sp.end_char").alias("end_char"),
                    F.col("z.sp.confidence").alias("confidence"),
                    F.col("z.cx.context_sentence").alias("context_sentence"))


def model_mentions(df: DataFrame, load_extractor: Callable[[], Callable[[str], list[dict]]],
                   text_col: str = "text", id_col: str = "article_id") -> DataFrame:
    """Pluggable entity model. ``load_extractor()`` runs once per Python worker and
    returns ``extract(text) -> [{start_char, end_char, label, score?}]``."""
    ex = with_model_spans(df.select(F.col(id_col), F.col(text_col).alias("_t")), load_extractor, "_t", "ents")
    return _model_rows(ex, id_col)


def landed_mentions(df: DataFrame, spans_col: str, text_col: str = "text", id_col: str = "article_id") -> DataFrame:
    """T8 from spans that a model has landed: an array of (start_char, end_char, label, score)
    per text."""
    return _model_rows(df.select(F.col(id_col), F.col(text_col).alias("_t"), F.col(spans_col).alias("ents")), id_col)


def extract_mentions(df: DataFrame, text_col: str = "text", id_col: str = "article_id",
                     load_extractor=None, compat: bool = False, spans_col: str | None = None) -> DataFrame:
    """Model rows where the model found something, regex rows for the rest. The model's
    spans are landed ones (``spans_col``) or come from ``load_extractor``, which runs once per
    text: its spans are staged so that both branches read the same ones."""
    if load_extractor is None and spans_col is None:
        return regex_mentions(df, text_col, id_col, compat)
    if spans_col is not None:
        ex = df.select(F.col(id_col), F.col(text_col).alias("_t"), F.col(spans_col).alias("ents"))
    else:
        ex = cut_lineage(with_model_spans(df.select(F.col(id_col), F.col(text_col).alias("_t")), load_extractor, "_t", "ents"))
    model = _model_rows(ex, id_col)
    rest = ex.join(model.select(id_col).distinct(), id_col, "left_anti")
    return model.unionByName(regex_mentions(rest, "_t", id_col, compat))


def analyze_text(df: DataFrame, text_col: str = "text", id_col: str = "article_id",
                 scorer: scoring.Scorer | None = None, load_extractor=None,
                 compat: bool = False) -> DataFrame:
    """Gate (>= 10 stripped chars) -> T9 -> D6 -> financial score.

    Scoring joins on the mention key, not on list position."""
    gated = df.where(stripped_length_at_least(F.col(text_col), 10))
    ents = extract_mentions(gated, text_col, id_col, load_extractor, compat)
    uniq = dedup.dedup_mentions(ents, id_col)
    scored = scoring.financial_sentiment(uniq, "context_sentence", scorer)
    return scored.select(id_col, "company_name", "ticker", "matched_text", "start_char", "end_char",
                         F.col("confidence").alias("confidence_score"), "context_sentence", "key_pos",
                         "sentiment_score", "sentiment_label", "positive_prob", "negative_prob",
                         "neutral_prob")


def article_text(title, content) -> Column:
    """T16 text: ``title + "\\n\\n" + content`` when the title is non-empty."""
    t, c = col_(title), col_(content)
    return F.when(t.isNotNull() & (t != ""), F.concat(t, F.lit("\n\n"), c)).otherwise(c)


def analyze_articles(articles: DataFrame, id_col: str = "article_id", title: str = "title",
                     content: str = "content", **kw) -> DataFrame:
    """Articles without content are skipped; records carry context[:500]."""
    src = (articles.where(F.col(content).isNotNull() & (F.col(content) != ""))
           .select(F.col(id_col), article_text(title, content).alias("_text")))
    return analyze_text(src, "_text", id_col, **kw)


def alias_lookup(df: DataFrame, text_col: str) -> DataFrame:
    """Case-insensitive exact alias lookup (name, ticker or null)."""
    info = F.try_element_at(dims.alias_map_expr(), F.lower(strip_ws(F.col(text_col))))
    return df.withColumn("company_name", info["name"]).withColumn("ticker", info["ticker"])


def tracked_companies(aliases: DataFrame) -> DataFrame:
    """One row per ticker, first-seen name, aliases in dictionary order."""
    return (aliases.groupBy("ticker")
            .agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("first_ord"),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "alias"))),
                                          lambda s: s["alias"]), "|").alias("aliases")))
