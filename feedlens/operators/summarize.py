"""Summaries.

``Summarizer`` is a ``DataFrame -> DataFrame`` transform over (id, text) with a name
that fills ``summarized_by``. The truncation summarizer is a projection; the extractive
ones take their sentence scores from ``rankers``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped_length_at_least, truncate_words, word_count
from ..session import cut_lineage
from . import rankers

NO_CONTENT = "No content available to summarize."


class Summarizer:
    name = "summarizer"

    def summarize(self, df: DataFrame, id_col: str, text_col: str, max_length: int) -> DataFrame:
        """Adds a ``summary`` column."""
        raise NotImplementedError


class TruncateSummarizer(Summarizer):
    """First max_length words + '...', unchanged when short enough."""
    name = "truncate"

    def summarize(self, df, id_col, text_col, max_length):
        return df.withColumn("summary", truncate_words(text_col, max_length))


def summary_record(articles: DataFrame, summarizer: Summarizer, max_length: int = 200) -> DataFrame:
    """text = content or description (empty -> fixed message, lengths 0); word
    counts of text and summary; ``summarized_by`` = the summarizer's name."""
    a = articles.withColumn("_t", F.coalesce(F.nullif("content", F.lit("")), F.nullif("description", F.lit("")),
                                             F.lit("")))
    s = summarizer.summarize(a, "ord", "_t", max_length)
    empty = F.col("_t") == ""
    return s.select(
        "ord", F.col("title").alias("original_title"), "source",
        F.when(empty, F.lit(NO_CONTENT)).otherwise(F.col("summary")).alias("summary"),
        F.lit(summarizer.name).alias("summarized_by"),
        F.when(empty, F.lit(0)).otherwise(word_count("_t")).cast("long").alias("original_length"),
        F.when(empty, F.lit(0)).otherwise(word_count("summary")).cast("long").alias("summary_length"))


# --- extractive rankers (T19) -------------------------------------------------------------

MIN_CHARS = 100


def sentence_count(max_length: int) -> int:
    return max(2, max_length // 20)


class RankedSummarizer(Summarizer):
    """The best sentences of a text by one of the ``rankers``, in the text's order. Texts of
    fewer than ``MIN_CHARS`` characters are their own summary; texts without any word (and
    summaries that come out empty) give their first 500 characters. Null stays null, repeated
    texts are ranked once, ids are never looked at."""

    def __init__(self, algorithm: str):
        if algorithm not in rankers.RANKERS:
            raise ValueError("algorithm must be one of: lsa, textrank, lexrank, luhn")
        self.algorithm = algorithm
        self.name = f"sumy-{algorithm}"

    def summarize(self, df, id_col, text_col, max_length):
        t = F.col(text_col)
        long = t.isNotNull() & stripped_length_at_least(t, MIN_CHARS)
        best = rankers.best_sentences(rankers.text_rows(df.where(long).select(text_col), text_col), self.algorithm, sentence_count(max_length))
        # staged, so that Spark can split the texts' side where one text has very many copies
        best = cut_lineage(best.withColumnRenamed("key", "_key").withColumnRenamed("best", "_best"))
        keyed = df.withColumn("_key", F.when(long, rankers.text_key(t))).withColumn(
            "summary", F.when(long, F.left(t, F.lit(500))).otherwise(t))
        # short texts have no key and take no part in the join
        done = keyed.where(F.col("_key").isNull()).drop("_key")
        ranked = keyed.where(F.col("_key").isNotNull()).join(best, "_key", "left")
        ranked = ranked.withColumn("summary", F.coalesce(F.nullif("_best", F.lit("")), "summary"))
        return done.unionByName(ranked.select(*done.columns))


FAILED_WORDS = 100


def cut_on_failure(rank, text: str | None, n: int) -> str | None:
    """``rank(text, n)``; where it fails the first ``FAILED_WORDS`` words and "..."."""
    if text is None:
        return None
    try:
        return rank(text, n)
    except Exception:  # noqa: BLE001  a document that the plugged-in ranker can't handle
        return " ".join(text.split()[:FAILED_WORDS]) + "..."


class PandasSummarizer(Summarizer):
    """A plugged-in ranker: ``load()`` gives ``rank(text, n) -> summary``, once per worker."""

    def __init__(self, name: str, load):
        self.name, self.load = name, load

    def summarize(self, df, id_col, text_col, max_length):
        load, n = self.load, sentence_count(max_length)

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            rank = load()
            for texts in batches:
                yield pd.Series([cut_on_failure(rank, t, n) for t in texts], dtype=object)
        return df.withColumn("summary", run(F.col(text_col)))


def configure_summarizer(algorithm: str) -> Summarizer:
    """Summarizer by name; unknown names raise."""
    return TruncateSummarizer() if algorithm == TruncateSummarizer.name else RankedSummarizer(algorithm)
