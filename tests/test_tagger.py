"""The entity tagger: exact decoding, held-out F1, windows of long texts."""
import itertools
import math
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SF001
from feedlens.operators import mentions, tagger
from feedlens.plans.queries import _labelled_names, tagger_fold
from feedlens.sources import tables as S

TRAIN = [("Shares of Acme Corp rose while Borealis fell.", [(10, 19), (31, 39)]), ("Acme Corp said it would buy Borealis.", [(0, 9), (28, 36)]),
         ("Nobody spoke of Cygnus today.", [(16, 22)]), ("It rained in May and in June.", []), (None, []), ("", None)]
SPANS = "text string, spans array<struct<start_char:long,end_char:long>>"


def test_decoding_finds_the_most_probable_tags(spark):
    model = tagger.fit(spark.createDataFrame(TRAIN, SPANS))

    def value(words, tags):
        total, last = 0.0, tagger.O
        for w, t in zip(words, tags):
            total, last = total + model.steps[last][t] + model.seen(w)[t], t
        return total + model.steps[last][tagger.O]
    for text in ("Shares of Acme Corp and Zenith fell.", "May Corp said Borealis", "of of Cygnus Acme", "x"):
        words = tagger.TOKEN.findall(text)
        best = max(value(words, t) for t in itertools.product(tagger.TAGS, repeat=len(words)))
        assert math.isclose(value(words, model.tags(words)), best, rel_tol=1e-12)
    assert model.extract("") == [] and [(e["start_char"], e["end_char"]) for e in model.extract("Borealis said Acme Corp rose.")] == [(0, 8), (14, 23)]


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame(TRAIN * 5, SPANS)
    one, many = tagger.fit(df.coalesce(1)), tagger.fit(df.repartition(7))
    assert one.words == many.words and one.shapes == many.shapes and one.steps == many.steps


def test_held_out_f1(spark):
    texts = S.doc_mention_texts(spark, SF001.replace("0.001", "0.01")).select("article_id", "text")
    held = tagger_fold("article_id")
    model = tagger.fit(_labelled_names(texts.where(~held)))
    rows = mentions.with_model_spans(texts.where(held), model.loader(), "text", "found").select("article_id", F.explode("found").alias("e"))
    got = {(r.article_id, r.s, r.t) for r in rows.select("article_id", F.col("e.start_char").alias("s"), F.col("e.end_char").alias("t")).collect()}
    want = {(r.article_id, r.start_char, r.end_char) for r in mentions.regex_mentions(texts.where(held)).collect()}
    both = len(got & want)
    assert len(want) > 200 and 2 * both / (len(got) + len(want)) >= 0.95


def test_whole_texts_are_tagged(spark):
    """A name far behind the first window, one across the border of two, none twice."""
    model = tagger.fit(spark.createDataFrame(TRAIN, SPANS))
    text = "it rained in may . " * 300 + "Acme Corp rose while " + "it rained in may . " * 300 + "Borealis fell."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = mentions.with_model_spans(df, model.loader(), "text", "e", max_chars=700, overlap=200).orderBy("id").collect()
    assert [text[e.start_char:e.end_char] for e in got[0].e] == ["Acme Corp", "Borealis"]
    assert got[1].e == [] and got[2].e == []


def test_batches_are_decoded_and_counted_like_single_texts():
    """All windows of a batch at once give the tags of one at a time; texts are counted piece by piece."""
    rng = random.Random(5)
    vocab = ["Acme", "Corp", "Borealis", "rose", "it", "rained", "May", "x-y", "Acme's", "1,5", "é", ".", "\n", "-", "Corp-"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", "  ", "", "\t", " "]) for _ in range(n))
    texts = ["", " ", "x", *(text(rng.randrange(1, 60)) for _ in range(300))]
    spans = [[{"start_char": m.start(), "end_char": m.end()} for m in re.finditer(r"Acme(?: +Corp)?|Borealis", t) if rng.random() < 0.7] for t in texts]
    words, steps = Counter(), Counter()
    for t, own in zip(texts, spans):
        last = tagger.O
        for w, tag in tagger.tagged(t, own):
            words[w, tag] += 1
            steps[last, tag] += 1
            last = tag
        steps[last, tagger.O] += 1
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(spans)], names=["text", "spans"])
    got = next(tagger.count_tags(iter([batch]))).to_pylist()
    assert {(r["word"], r["tag"]): r["n"] for r in got if r["kind"] == "e"} == dict(words)
    assert {(int(r["word"]), r["tag"]): r["n"] for r in got if r["kind"] == "t"} == dict(steps)
    seen: dict = {}
    for (w, tag), n in words.items():
        seen.setdefault(w, {})[tag] = n
    model = tagger.Tagger(steps, {w: n for w, n in seen.items() if w != "May"}, {"x": {0: 5, 1: 1}})
    model.CHUNK = 64
    assert [list(x) for x in model.tags_of([tagger.TOKEN.findall(t) for t in texts])] == [model.tags(tagger.TOKEN.findall(t)) for t in texts]
    found = model.many(texts)
    assert found == [model.extract(t) for t in texts] and any(found)
    assert all(t[e["start_char"]:e["end_char"]] == t[e["start_char"]:e["end_char"]].strip() for t, f in zip(texts, found) for e in f)
