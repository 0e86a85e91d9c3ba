"""Learned scores with calibrated probabilities (T11, T13), out of fold.

Rows are dealt to three folds by a hash of their key. The rows of a fold are scored by a
logistic regression over hashed words that was fitted on the next fold, and made into
probabilities by an isotonic regression fitted on the fold after that: no row is scored or
calibrated by anything that saw it, labelled or not. Every labelled row takes part, fitting
runs on Spark ML.

Isotonic regression is fitted on scores in ``BINS`` steps, with the rows of a step as its
weight, so what it sorts and keeps is bounded whatever the corpus. Null texts are empty, null
labels and keys take no part in fitting (null keys count as fold 0 when scored). With a fold
whose labels are all alike or missing, the score is that share of positives (0.5 without any).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .scoring import tokens

FOLDS = 3
BINS = 1000
FEATURES = 1 << 15
ROUNDS = 30
PENALTY = 0.003    # of the absolute weights: words that tell nothing get none


def fold_of(key) -> Column:
    """0, 1 or 2, by a checksum of the key written out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(0)).cast("int")


def with_features(df: DataFrame, text_col: str, features: int) -> DataFrame:
    """Adds ``_x``: which (hashed) words a text holds."""
    from pyspark.ml.feature import HashingTF
    words = F.filter(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: t != "")
    d = df.withColumn("_tok", F.array_distinct(words))
    return HashingTF(inputCol="_tok", outputCol="_x", numFeatures=features, binary=True).transform(d).drop("_tok")


def out_of_fold(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "label",
                features: int = FEATURES) -> DataFrame:
    """key, fold, raw (the regression's probability), probability (calibrated) of every row of
    ``df``. ``labels``: key, ``label_col`` (0 or 1; of several the largest counts)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    known = cut_lineage(labels.where(F.col(key).isNotNull() & F.col(label_col).isNotNull())
                        .groupBy(key).agg(F.max(label_col).cast("double").alias("_y")))
    rows = cut_lineage(with_features(df.select(key, text_col), text_col, features).drop(text_col).withColumn("fold", fold_of(key)))
    taught = cut_lineage(rows.join(known, key))
    shares = {r["fold"]: (r["s"], r["n"]) for r in taught.groupBy("fold").agg(F.sum("_y").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for f in range(FOLDS):
        fit, cal = (f + 1) % FOLDS, (f + 2) % FOLDS
        own = rows.where(F.col("fold") == f)
        mixed = all(0 < shares.get(k, (0, 0))[0] < shares.get(k, (0, 0))[1] for k in (fit, cal))
        if not mixed:
            s, n = (sum(shares.get(k, (0, 0))[i] for k in (fit, cal)) for i in (0, 1))
            share = F.lit(s / n if n else 0.5)
            parts.append(own.select(key, "fold", share.alias("raw"), share.alias("probability")))
            continue
        model = LogisticRegression(featuresCol="_x", labelCol="_y", regParam=PENALTY, elasticNetParam=1.0, maxIter=ROUNDS).fit(taught.where(F.col("fold") == fit))

        def scored(d: DataFrame, model=model) -> DataFrame:
            p = vector_to_array("probability")[1]
            return model.transform(d).withColumn("raw", p).withColumn("_bin", F.round(F.col("raw") * BINS) / BINS).drop("probability", "rawPrediction", "prediction")
        steps = (scored(taught.where(F.col("fold") == cal)).groupBy("_bin")
                 .agg(F.avg("_y").alias("_share"), F.count(F.lit(1)).cast("double").alias("_n")))      # BINS + 1 rows at most
        iso = IsotonicRegression(featuresCol="_bin", labelCol="_share", weightCol="_n", predictionCol="probability").fit(steps)
        parts.append(iso.transform(scored(own)).select(key, "fold", "raw", F.col("probability")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def quality_of(scores: DataFrame, labels: DataFrame, key: str = "doc_id", label_col: str = "label") -> DataFrame:
    """auc (area under the ROC curve, ties halved) and calibration_error (mean absolute gap of
    probability and share of positives over tenths, by their rows), of the labelled rows. Sums
    over ``BINS`` steps: windows never see more rows than that."""
    from pyspark.sql import Window
    y = labels.select(key, F.col(label_col).cast("double").alias("_y"))
    d = scores.join(y, key).select(F.round("probability", 3).alias("p"), "probability", "_y")
    at = d.groupBy("p").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
    up = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)          # at most 1001 rows
    auc = (at.withColumn("below", F.coalesce(F.sum("neg").over(up), F.lit(0.0)))
           .agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc")))
    tenth = d.groupBy(F.floor(F.least(F.lit(9.0), F.col("probability") * 10)).alias("t")).agg(
        F.abs(F.sum("probability") - F.sum("_y")).alias("gap"), F.count(F.lit(1)).alias("n"))
    error = tenth.agg((F.sum("gap") / F.sum("n")).alias("calibration_error"))
    return auc.join(error)


def learned_sentiment(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "label") -> DataFrame:
    """T11/T12 by learning: key, fold, negative (the calibrated probability of label 1), neutral,
    positive, compound, label."""
    from .scoring import with_label
    s = out_of_fold(df, labels, key, text_col, label_col)
    return with_label(s.select(key, "fold", F.col("probability").alias("negative"), F.lit(0.0).alias("neutral"),
                               (1 - F.col("probability")).alias("positive")))
