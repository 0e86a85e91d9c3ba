"""Small fixtures with the awkward cases every operator must bear."""

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, "
        "size long, target double, fp long, root long, key long, bucket int, g int, words string, __id long")

LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(20_000))
EXTRA = (7, 1.5, 3, 4, 5, 6, 8, "clash", 9)


def doc(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def awkward(spark, more=()):
    rows = [doc(1, "the cat sat on the mat"), doc(1, "the cat sat on the mat"), doc(2, None), doc(3, ""), doc(4, " \t\n "),
            doc(None, "no id here", None, None), doc(None, None, None, None), doc(5, LONG), doc(6, LONG, "de", "b"),
            doc(7, "the cat sat on the mat", "fr", None), doc(8, "über Ärger 你好 x\n\nEnde", "de", "ä"), doc(9, "!!! 123 ???"),
            *more]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
