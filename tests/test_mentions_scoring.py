import re

import pytest
from pyspark.sql import functions as F

from feedlens.operators import mentions as MN
from feedlens.operators import scoring as SC
from feedlens.sources import dims


TEXTS = {
    "Nvidia Corp rose. Apple Inc. said AWS and amazon.com grew!  Then   TSLA fell? Meta and apple are skipped.":
        [("NVDA", "Nvidia Corp"), ("AAPL", "Apple Inc"), ("AMZN", "AWS"), ("AMZN", "amazon.com"), ("TSLA", "TSLA")],
    "no mention here at all": [],
    "MICROSOFT CORPORATION and Microsoft Corp.\n\n\nGoogle, GOOGL, GOOG; alphabet inc. Tesla Motors.":
        [("MSFT", "MICROSOFT CORPORATION"), ("MSFT", "Microsoft Corp"), ("GOOGL", "Google"), ("GOOGL", "GOOGL"),
         ("GOOGL", "GOOG"), ("GOOGL", "alphabet inc"), ("TSLA", "Tesla")],
    "x" * 50 + ".    " + "Wide gaps.     Nvidia here.": [("NVDA", "Nvidia")],
}


@pytest.mark.parametrize("compat", [True, False])
def test_regex_mentions(spark, compat):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "article_id long, text string")
    got = sorted(MN.regex_mentions(df, compat=compat).select(
        "article_id", "start_char", "ticker", "matched_text", "end_char", "context_sentence").collect())
    for i, (text, want) in enumerate(TEXTS.items()):
        mine = [r for r in got if r.article_id == i]
        assert [r.ticker for r in mine] == [t for t, _ in want]
        assert all(r.matched_text.startswith(m) for r, (_, m) in zip(mine, want))
        assert all(text[r.start_char:r.end_char] == r.matched_text for r in mine)
        assert all(r.context_sentence in text for r in mine)
        if not compat:
            assert all(r.matched_text in r.context_sentence for r in mine)


def test_compat_context_drifts_after_wide_gaps(spark):
    # the walk counts one character per gap: the second match lies behind "Then ..." for it
    t = "One Nvidia." + " " * 20 + "Two Tesla fell."
    df = spark.createDataFrame([(1, t)], "article_id long, text string")
    got = {c: [r.context_sentence for r in MN.regex_mentions(df, compat=c).orderBy("start_char").collect()] for c in (False, True)}
    assert got[False] == ["One Nvidia.", "Two Tesla fell."]
    assert got[True] == ["One Nvidia.", t]


def test_contexts_of_a_long_text(spark):
    """More sentences and matches than one block of offsets, and time in proportion."""
    t = " ".join(f"S{i} Nvidia {'x' * (i % 7)}." if i % 2 else f"Nothing {i}!" for i in range(1500))
    df = spark.createDataFrame([(1, t)], "article_id long, text string")
    got = MN.regex_mentions(df).orderBy("start_char").collect()
    assert [r.context_sentence for r in got] == [f"S{i} Nvidia {'x' * (i % 7)}." for i in range(1, 1500, 2)]
    assert all(t[r.start_char:r.end_char] == "Nvidia" for r in got)


def test_model_reads_whole_texts(spark):
    def load():
        return lambda text: [{"start_char": m.start(), "end_char": m.end(), "label": "ORG"} for m in re.finditer("Nvidia", text)]

    t = "filler words go on. " * 2000 + "Nvidia came last." + " Then more." * 300 + " Nvidia again."
    df = spark.createDataFrame([(1, t), (2, None)], "article_id long, text string")
    got = MN.model_mentions(df, load).orderBy("start_char").collect()
    assert [r.start_char for r in got] == [m.start() for m in re.finditer("Nvidia", t)]
    assert [r.context_sentence for r in got] == ["Nvidia came last.", "Nvidia again."]


def test_windows_cover_every_place_once():
    for n in (0, 1, 99, 100, 101, 950, 1000, 5003):
        parts = list(MN._windows("x" * n, 100, 10))
        assert [i for _, _, a, b in parts for i in range(a, b)] == list(range(n))
        assert all(at <= a and b <= at + len(w) for at, w, a, b in parts)


def test_exact_context_is_containing_sentence(spark):
    t = "First one.     Second has Nvidia inside.   Third."
    df = spark.createDataFrame([(1, t)], "article_id long, text string")
    r = MN.regex_mentions(df).first()
    assert r.context_sentence == "Second has Nvidia inside."
    assert t[r.start_char:r.end_char] == "Nvidia"


def test_model_path_filters_and_falls_back(spark):
    def load():
        def extract(text):
            out = []
            for m in re.finditer(r"Nvidia|Tesla|Acme", text):
                out.append({"start_char": m.start(), "end_char": m.end(), "label": "company", "score": 0.77})
                out.append({"start_char": m.start(), "end_char": m.end(), "label": "ORG"})  # same span again
            return out
        return extract

    df = spark.createDataFrame([(1, "Nvidia and Acme met Tesla."), (2, "Only MSFT here, nothing for the model.")],
                               "article_id long, text string")
    got = sorted(tuple(r) for r in MN.extract_mentions(df, load_extractor=load).select(
        "article_id", "ticker", "start_char", "confidence").collect())
    assert got == [(1, "NVDA", 0, 0.77), (1, "TSLA", 20, 0.77), (2, "MSFT", 5, 0.9)]


def test_alias_lookup_and_tracked_companies(spark):
    df = spark.createDataFrame([(" Nvidia Corporation ",), ("acme",)], "t string")
    assert [tuple(r) for r in MN.alias_lookup(df, "t").select("ticker", "company_name").collect()] == [
        ("NVDA", "Nvidia"), (None, None)]
    tc = {r.ticker: r for r in MN.tracked_companies(dims.company_aliases(spark)).collect()}
    assert len(tc) == 7 and tc["AMZN"].aliases.split("|")[:2] == ["amazon", "amazon.com"]


def test_seed_companies(spark):
    c = dims.companies(spark).orderBy("id").collect()
    assert [r.ticker for r in c] == ["AAPL", "MSFT", "GOOGL", "AMZN", "META", "TSLA", "NVDA"]


def test_labels_ties_and_neutral(spark):
    df = spark.createDataFrame([(0.4, 0.2, 0.4), (0.3, 0.4, 0.3), (0.2, 0.2, 0.6)], "negative double, neutral double, positive double")
    assert [r.label for r in SC.with_label(df).collect()] == ["positive", "neutral", "positive"]


def test_lexicon_and_blank_text(spark):
    df = spark.createDataFrame([("Shares rose and beat forecasts",), ("   ",), ("It fell.",)], "t string")
    r = SC.sentiment(df, "t").collect()
    assert r[0].label == "positive" and r[1].neutral == 1.0 and r[2].label == "negative"


def test_financial_single_form_defaults_on_empty(spark):
    df = spark.createDataFrame([("",)], "t string")
    r = SC.financial_sentiment(df, "t", batch_form=False).first()
    assert (r.sentiment_label, r.score, r.positive_prob, r.negative_prob, r.neutral_prob) == \
        ("neutral", 0.5, 0.33, 0.33, 0.34)


def test_pandas_model_scorer_and_label_alias(spark):
    def load():
        return lambda texts: [{"LABEL_0": 0.1, "LABEL_1": 0.2, "LABEL_2": 0.7} for _ in texts]
    df = spark.createDataFrame([("good",), ("bad",)], "t string")
    r = SC.sentiment(df, "t", SC.PandasModelScorer(load)).collect()
    assert [x.label for x in r] == ["positive", "positive"] and abs(r[0].compound - 0.6) < 1e-9
    df = spark.createDataFrame([("LABEL_0",), ("Positive",)], "l string")
    assert [x[0] for x in df.select(SC.label_alias(F.col("l"))).collect()] == ["negative", "positive"]


def test_prefilter_keeps_every_mention(spark):
    texts = [*TEXTS, "Teſla and ＡＷＳ are odd", "plain text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "article_id long, text string")
    a = sorted(tuple(r) for r in MN.regex_mentions(df).collect())
    b = sorted(tuple(r) for r in MN.regex_mentions(df, prefilter=True).collect())
    assert a == b and len(a) > 5


def test_trie_pattern_equals_longest_first_alternation():
    import random
    flat = r"\b(" + "|".join(re.escape(a) for a in dims.regex_aliases()) + r")\b"
    trie = dims.alias_trie_pattern()
    rnd = random.Random(11)
    pieces = dims.regex_aliases() + ["x", " ", ".", "s", "Inc", "inc.", "Corp", "web", "-", "é", "googles", "aw"]
    for _ in range(5000):
        t = "".join(rnd.choice(pieces) + rnd.choice(["", " ", ".", "!"]) for _ in range(rnd.randint(1, 8)))
        a = [(m.start(), m.group(1)) for m in re.finditer(flat, t, re.I)]
        b = [(m.start(), m.group(1)) for m in re.finditer(trie, t, re.I)]
        assert a == b, t


def test_regex_mentions_random_texts(spark):
    import random
    rnd = random.Random(21)
    pieces = [a for a, _, _ in dims.COMPANY_ALIASES] + ["Shares", "rose", "fell", "today", "x", "Inc", "the"]
    seps = [" ", " ", ".  ", "! ", "?\n\n", ", ", "-", "\t", ". "]
    texts = ["".join(rnd.choice(pieces).upper() if rnd.random() < .2 else rnd.choice(pieces) + rnd.choice(seps)
                     for _ in range(rnd.randint(1, 30))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "article_id long, text string")
    flat = re.compile(r"\b(" + "|".join(re.escape(a) for a in dims.regex_aliases()) + r")\b", re.I)
    names = {a: t for a, _, t in dims.COMPANY_ALIASES}
    got = MN.regex_mentions(df).collect()
    want = sorted((i, m.start(), m.end(), names[m.group(1).lower()]) for i, t in enumerate(texts) for m in flat.finditer(t))
    assert sorted((r.article_id, r.start_char, r.end_char, r.ticker) for r in got) == want
    for r in got:
        assert r.context_sentence in texts[r.article_id] and r.matched_text.strip() in r.context_sentence
        assert not re.search(r"[.!?]\s", r.context_sentence)


def test_failing_models_score_neutral(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")

    def broken():
        raise RuntimeError("no weights")

    def moody():
        def predict(texts):
            raise ValueError("bad batch")
        return predict
    for load in (broken, moody):
        got = SC.sentiment(df, "t", SC.PandasModelScorer(load)).collect()
        assert [(r.negative, r.neutral, r.positive, r.label) for r in got] == [(0.0, 1.0, 0.0, "neutral")] * 2


def test_failing_summarizer_cuts_after_100_words(spark):
    from feedlens.operators import summarize as SM
    text = " ".join(f"w{i}" for i in range(150))
    want = " ".join(f"w{i}" for i in range(100)) + "..."

    def broken(text, n):
        raise ValueError("no ranks")
    assert SM.cut_on_failure(broken, text, 3) == want
    df = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
    got = SM.PandasSummarizer("mine", lambda: broken).summarize(df, "id", "t", 100).orderBy("id").collect()
    assert [r.summary for r in got] == [want, None]


def test_spark_ml_scorer(spark):
    rows = [(f"good growth record {i}", "LABEL_2") for i in range(30)] + [(f"bad loss crash {i}", "negative") for i in range(30)]
    scorer = SC.SparkMLScorer.fit(spark.createDataFrame(rows, "text string, label string"), features=1 << 12)
    df = spark.createDataFrame([("a good record",), ("a crash and a loss",), ("",), (None,)], "t string")
    got = SC.sentiment(df, "t", scorer).collect()
    assert [r.label for r in got] == ["positive", "negative", "neutral", "neutral"]
    assert df.columns == ["t"] and got[0].positive > 0.8
