"""Learned, calibrated scores: nothing is scored by a model that saw it; AUC and calibration."""
import zlib

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from feedlens.operators import calibrated as C
from feedlens.sources import tables as S

SF01 = SF001.replace("0.001", "0.01")


def test_auc_and_calibration(spark):
    labels = S.table(spark, SF01, "labels").select("doc_id", F.col("toxic").alias("label"))
    scores = C.out_of_fold(S.table(spark, SF01, "documents"), labels).cache()
    assert scores.count() == 1000 and scores.where("probability BETWEEN 0 AND 1").count() == 1000
    q = C.quality_of(scores, labels).first()
    assert q["auc"] >= 0.8 and q["calibration_error"] <= 0.05
    got = scores.join(labels, "doc_id").select(F.round("probability", 3).alias("p"), "label").collect()
    pos, neg = [r.p for r in got if r.label], [r.p for r in got if not r.label]
    plain = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert q["auc"] == pytest.approx(plain)


def table(spark, flip=None):
    """Texts whose word 'bad' tells the label; ``flip``: a fold whose labels are turned round."""
    rows, labels = [], []
    for i in range(240):
        y = i % 3 == 0
        rows.append((i, f"word{i % 17} " + ("bad thing" if y else "fine thing"), "clash"))
        if i % 5:
            labels.append((i, int(y != (flip is not None and zlib.crc32(str(i).encode()) % 3 == flip))))
    rows += [(None, "bad", "x"), (1000, None, "x"), (1000, "bad", "x")]
    labels += [(None, 1), (1, None), (999, 1), (3, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_no_row_is_scored_by_what_saw_it(spark):
    """Turning the labels of one fold round changes no score of that fold."""
    df, labels = table(spark)
    before = {(r.doc_id, r.fold): r.probability for r in C.out_of_fold(df, labels).where("doc_id < 500").collect()}
    for fold in range(3):
        after = {(r.doc_id, r.fold): r.probability for r in C.out_of_fold(*table(spark, fold)).where("doc_id < 500").collect()}
        assert all(after[k] == pytest.approx(v, abs=1e-9) for k, v in before.items() if k[1] == fold)
        assert any(abs(after[k] - v) > 0.2 for k, v in before.items() if k[1] != fold)
    assert min(v for (i, _), v in before.items() if i % 3 == 0) > max(v for (i, _), v in before.items() if i % 3)


def test_awkward_rows(spark):
    df, labels = table(spark)
    got = C.learned_sentiment(df, labels).collect()
    assert len(got) == 243 and {r.label for r in got} == {"positive", "negative"}
    assert [r.label for r in got if r.doc_id is None] == ["negative"]
    none = C.out_of_fold(df, labels.limit(0)).collect()
    assert len(none) == 243 and {r.probability for r in none} == {0.5}
    alike = C.out_of_fold(df, labels.where("label = 1")).collect()
    assert {r.probability for r in alike} == {1.0}
    assert C.out_of_fold(df.limit(0), labels).count() == 0
