"""Sentiment scoring slots (T11-T14, T17) and the built-in lexicon scorer.

The service scores text with pretrained transformer models that are not shipped
here; a missing model makes it return fixed neutral scores. We keep that contract:

* ``Scorer`` turns a text column into (negative, neutral, positive) probabilities.
* ``LexiconScorer`` is the built-in, JVM-side scorer (token counts against a small
  word list) — no Python, no shuffle: it is a projection.
* ``NeutralScorer`` is the "model unavailable" behaviour of the service.
* ``PandasModelScorer`` plugs any batch model in through an Arrow iterator UDF, so a
  model is loaded once per Python worker and fed whole Arrow batches.
* ``SparkMLScorer`` trains and applies a Spark ML pipeline (hashed word counts, logistic
  regression).
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_, is_blank

# --- fixed values: label aliases used by sentiment model outputs -----------------------
LABEL_ALIASES = {"LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive",
                 "negative": "negative", "neutral": "neutral", "positive": "positive"}
# --------------------------------------------------------------------------------------

# Word lists of the built-in lexicon scorer (our stand-in model, not the service's).
POSITIVE_WORDS = ("gain", "gains", "rose", "rise", "rises", "grew", "growth", "beat", "beats",
                  "rallied", "rally", "strong", "record", "profit", "surge", "surged",
                  "improve", "improved", "good", "great", "positive", "success", "up")
NEGATIVE_WORDS = ("fell", "fall", "falls", "drop", "dropped", "loss", "losses", "miss", "missed",
                  "weak", "decline", "declined", "cut", "cuts", "bad", "poor", "negative",
                  "risk", "crash", "slump", "down")
TOKEN_SPLIT = r"[^\p{L}\p{N}_]+"

PROBS = ("negative", "neutral", "positive")


def tokens(text) -> Column:
    return F.split(F.lower(col_(text)), TOKEN_SPLIT)


class Scorer:
    name = "scorer"

    def probs(self, df: DataFrame, text_col: str) -> DataFrame:
        """Adds double columns negative, neutral, positive."""
        raise NotImplementedError


class LexiconScorer(Scorer):
    name = "lexicon"

    def probs(self, df: DataFrame, text_col: str) -> DataFrame:
        # the tokens are a column of their own: named twice below, so they are split once
        p = F.size(F.filter("_tok", lambda t: t.isin(*POSITIVE_WORDS))).cast("double")
        n = F.size(F.filter("_tok", lambda t: t.isin(*NEGATIVE_WORDS))).cast("double")
        df = df.withColumn("_tok", tokens(text_col))
        blank = is_blank(text_col)
        d = F.col("_p") + F.col("_n") + 1.0
        return (df.withColumn("_p", p).withColumn("_n", n)
                .withColumn("negative", F.when(blank, 0.0).otherwise(F.col("_n") / d))
                .withColumn("neutral", F.when(blank, 1.0).otherwise(1.0 / d))
                .withColumn("positive", F.when(blank, 0.0).otherwise(F.col("_p") / d))
                .drop("_tok", "_p", "_n"))


class NeutralScorer(Scorer):
    """Model unavailable: every text scores neutral."""
    name = "neutral"

    def __init__(self, neg=0.0, neu=1.0, pos=0.0):
        self.v = (neg, neu, pos)

    def probs(self, df, text_col):
        return (df.withColumn("negative", F.lit(self.v[0])).withColumn("neutral", F.lit(self.v[1]))
                .withColumn("positive", F.lit(self.v[2])))


class PandasModelScorer(Scorer):
    """Batch model hook. ``load()`` returns ``predict(list[str]) -> list[dict[label, p]]``;
    labels go through the alias map (LABEL_0/1/2) and otherwise are lowercased. A batch that
    the model fails on scores neutral, as does everything when it cannot be loaded."""

    def __init__(self, load: Callable[[], Callable[[list[str]], list[dict]]], name="model",
                 max_chars: int | None = None):
        self.load, self.name, self.max_chars = load, name, max_chars

    def probs(self, df, text_col):
        load = self.load
        schema = T.StructType([T.StructField(k, T.DoubleType()) for k in PROBS])

        @F.pandas_udf(schema)
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            try:
                predict = load()  # once per worker process
            except Exception:  # noqa: BLE001  a model that can't be loaded: neutral, as the service
                predict = None
            for s in batches:
                texts = s.fillna("").tolist()
                try:
                    out = []
                    for res in predict(texts):
                        d = {LABEL_ALIASES.get(k, k.lower()): float(v) for k, v in res.items()}
                        out.append({k: d.get(k, 0.0) for k in PROBS})
                    if len(out) != len(texts):
                        raise ValueError("one result per text is asked for")
                except Exception:  # noqa: BLE001  any failure of a plugged-in model
                    out = [{"negative": 0.0, "neutral": 1.0, "positive": 0.0}] * len(texts)
                yield pd.DataFrame(out, columns=list(PROBS))

        t = col_(text_col)
        if self.max_chars:
            t = F.left(t, F.lit(self.max_chars))
        df = df.withColumn("_s", score(t))
        return df.select("*", *[F.col(f"_s.{k}").alias(k) for k in PROBS]).drop("_s")


class SparkMLScorer(Scorer):
    """T11 on Spark ML: word counts hashed into ``features`` cells and a multinomial logistic
    regression. Labels are named like the probabilities (``LABEL_ALIASES`` apply)."""
    name = "spark-ml"

    def __init__(self, model, labels: list[str]):
        self.model, self.labels = model, labels

    @classmethod
    def fit(cls, df: DataFrame, text_col: str = "text", label_col: str = "label", features: int = 1 << 16,
            max_rows: int | None = None, rounds: int = 30) -> SparkMLScorer:
        """Learns from all rows with a label, or from ``max_rows`` of them by hash of the text."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import HashingTF, StringIndexer
        rows = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), label_alias(F.col(label_col)).alias("_label"))
        rows = rows.where(F.col("_label").isNotNull()).withColumn("_tok", tokens("_text"))
        if max_rows is not None:
            rows = rows.orderBy(F.xxhash64("_text")).limit(max_rows)
        index = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc")
        steps = [index, HashingTF(inputCol="_tok", outputCol="_x", numFeatures=features),
                 LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.01, maxIter=rounds, family="multinomial")]
        model = Pipeline(stages=steps).fit(rows)
        return cls(model, list(model.stages[0].labels))

    def probs(self, df: DataFrame, text_col: str) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        d = df.withColumn("_tok", tokens(F.coalesce(col_(text_col), F.lit(""))))
        for stage in self.model.stages[1:]:
            d = stage.transform(d)
        d = d.withColumn("_p", vector_to_array("probability"))
        for name in PROBS:
            known = [i for i, x in enumerate(self.labels) if x == name]
            d = d.withColumn(name, F.col("_p")[known[0]] if known else F.lit(0.0))
        return d.drop("_tok", "_x", "_p", "rawPrediction", "probability", "prediction")


def with_label(df: DataFrame) -> DataFrame:
    """compound = positive - negative; argmax label, ties positive > negative > neutral."""
    pos, neg, neu = F.col("positive"), F.col("negative"), F.col("neutral")
    label = (F.when((pos >= neg) & (pos >= neu), "positive")
             .when((neg >= pos) & (neg >= neu), "negative").otherwise("neutral"))
    return df.withColumn("compound", pos - neg).withColumn("label", label)


def sentiment(df: DataFrame, text_col: str, scorer: Scorer | None = None) -> DataFrame:
    """T11+T12: general sentiment of a text column; blank text is neutral (0, 1, 0)."""
    scorer = scorer or LexiconScorer()
    out = scorer.probs(df, text_col)
    blank = is_blank(text_col)
    out = (out.withColumn("negative", F.when(blank, 0.0).otherwise(F.col("negative")))
           .withColumn("neutral", F.when(blank, 1.0).otherwise(F.col("neutral")))
           .withColumn("positive", F.when(blank, 0.0).otherwise(F.col("positive"))))
    return with_label(out)


def financial_sentiment(df: DataFrame, text_col: str, scorer: Scorer | None = None,
                        batch_form: bool = True) -> DataFrame:
    """T13+T14: label = argmax (ties positive > negative > neutral), score = winning
    probability, normalized = positive - negative. The single-text form (``batch_form``
    False) returns neutral 0.5 / (.33, .33, .34) for an empty text."""
    scorer = scorer or LexiconScorer()
    out = scorer.probs(df, text_col)
    pos, neg, neu = F.col("positive"), F.col("negative"), F.col("neutral")
    label = (F.when((pos >= neg) & (pos >= neu), "positive")
             .when((neg >= pos) & (neg >= neu), "negative").otherwise("neutral"))
    score = (F.when((pos >= neg) & (pos >= neu), pos)
             .when((neg >= pos) & (neg >= neu), neg).otherwise(neu))
    out = (out.withColumn("sentiment_label", label).withColumn("score", score)
           .withColumnRenamed("positive", "positive_prob")
           .withColumnRenamed("negative", "negative_prob")
           .withColumnRenamed("neutral", "neutral_prob"))
    if not batch_form:
        empty = col_(text_col).isNull() | (col_(text_col) == "")
        for c, v in (("sentiment_label", "neutral"), ("score", 0.5), ("positive_prob", 0.33),
                     ("negative_prob", 0.33), ("neutral_prob", 0.34)):
            out = out.withColumn(c, F.when(empty, F.lit(v)).otherwise(F.col(c)))
    return out.withColumn("sentiment_score", F.col("positive_prob") - F.col("negative_prob"))


def label_alias(label) -> Column:
    """LABEL_0/1/2 -> names, else lowercase."""
    kv = []
    for k, v in LABEL_ALIASES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.coalesce(F.try_element_at(F.create_map(*kv), col_(label)), F.lower(col_(label)))
