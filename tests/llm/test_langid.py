import re
import zlib

import numpy as np

from feedlens.llm import langid
from feedlens.llm.common import load
from helpers import DOCS, awkward, doc, no_docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = load(spark, SF, "documents")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = langid.identify(docs).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.95


def brute_bundle(text, letters={}):
    """Sum of the bound, rotated letter vectors of a text's n-grams, one n-gram at a time."""
    s = "".join(c if c.isalpha() or not (c.isdigit() or c == "_" or not re.match(r"\w", c)) else " " for c in (text or "").lower())
    s = re.sub(" +", " ", s).strip(" ")
    total = np.zeros(langid.DIM)
    if not any(map(str.isalpha, s)):
        return None
    for i in range(len(s) + 2 - langid.NGRAM + 1):
        bound = np.ones(langid.DIM)
        for place, c in enumerate(reversed(f" {s} "[i:i + langid.NGRAM])):
            if c not in letters:
                signs = np.random.default_rng([langid.SEED, ord(c)]).integers(0, 2, langid.DIM)
                letters[c] = np.where(signs == 1, 1.0, -1.0)
            bound = bound * np.concatenate([letters[c][langid.DIM - place:], letters[c][:langid.DIM - place]])
        total += bound
    return total


def test_equals_brute_force(spark):
    docs = load(spark, SF, "documents").where("length(text) < 400").limit(150).select("doc_id", "text", "lang")
    docs = docs.unionByName(awkward(spark).where("coalesce(doc_id, 0) NOT IN (5, 6)").select("doc_id", "text", "lang"))
    rows = docs.collect()
    docs = spark.createDataFrame(rows, docs.schema)
    out = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows]
    bundles = [brute_bundle(r["text"]) for r in rows]
    names = sorted({r["lang"] for r, o, b in zip(rows, out, bundles) if r["lang"] and not o and b is not None})
    unit = np.array([sum(b for r, o, b in zip(rows, out, bundles) if r["lang"] == n and not o and b is not None) for n in names])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    centre = unit.mean(axis=0)
    own = (unit - centre) / np.linalg.norm(unit - centre, axis=1, keepdims=True)
    want = []
    for r, o, b in zip(rows, out, bundles):
        if b is None:
            want.append((r["doc_id"] or 0, o, langid.UNKNOWN, 0.0))
            continue
        off = b / np.linalg.norm(b) - centre
        cos = own @ off / np.linalg.norm(off)
        e = np.exp(langid.SHARPNESS * cos)
        want.append((r["doc_id"] or 0, o, names[int(cos.argmax())], float(e.max() / e.sum())))
    got = sorted((r["doc_id"] or 0, r["held_out"], r["lang_pred"], r["score"]) for r in langid.identify(docs).collect())
    want.sort()
    assert len(names) > 1 and [g[:3] for g in got] == [w[:3] for w in want]
    assert max(abs(g[3] - w[3]) for g, w in zip(got, want)) < 1e-9


def test_bound_vectors():
    a, b = (langid._GRAMS.at(langid.grams(t))[1].astype(int) for t in (b"abc", b"abd"))
    assert set(a) <= {-1, 1} and abs((a * b).sum()) < 0.2 * langid.DIM
    assert (langid.bundle(langid.grams(b"aab")) == langid.bundle(langid.grams("AAB!! 12".encode()))).all()


def test_awkward_rows(spark):
    texts = {"en": "the cat and the dog went with the others", "de": "der Hund und die Katze gingen mit den anderen"}
    more = [doc(100 + i, texts[x], x) for i, x in enumerate(["en", "de"] * 20)]
    got = langid.identify(awkward(spark, more)).collect()
    assert len(got) == 52
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert by[100]["lang_pred"] == "en" and by[101]["lang_pred"] == "de"
    kept = langid.keep_language(awkward(spark, more))
    assert kept.columns == awkward(spark).columns
    assert sorted({r["doc_id"] or 0 for r in kept.collect()} & set(range(10))) == [0, 1, 5, 6, 7, 8]


def test_nothing_learned(spark):
    docs = spark.createDataFrame([doc(1, "some text", None), doc(2, "other", None)], DOCS)
    assert {r["lang_pred"] for r in langid.identify(docs).collect()} == {"und"}
    assert langid.identify(no_docs(spark)).count() == 0 and langid.keep_language(no_docs(spark)).count() == 0


def test_short_clean_texts_stay_and_foreign_or_gibberish_texts_go(spark):
    labelled = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    short = labelled.where("length(text) <= 60")
    fi = ("Suomen kieli kuuluu uralilaisiin kieliin ja sitä puhuu yli viisi miljoonaa ihmistä pääasiassa Suomessa mutta myös "
          "Ruotsissa ja Virossa, ja monet viettävät kesälomansa järven rannalla mökillä.")
    it = ("La città è famosa per le sue piazze antiche e per i mercati che si tengono ogni settimana nel centro storico, e gli "
          "abitanti parlano volentieri con i visitatori.")
    idn = ("Masyarakat desa itu bekerja bersama untuk membangun jembatan baru yang akan menghubungkan dua sungai besar, dan "
           "setiap pagi mereka berkumpul di lapangan.")
    rng = np.random.default_rng(4)
    junk = " ".join("".join(chr(97 + i) for i in rng.integers(0, 26, rng.integers(2, 10))) for _ in range(5000))
    more = [(-1, "Avec.", None), (-2, "A.", None), (-3, "This.", None), (-4, "Èrépa " * 2000, None),
            (-11, fi, None), (-12, it, None), (-13, idn, None), (-14, junk, None), (-15, "Привет", None), (-16, "你好", None)]
    docs = labelled.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    got = {r["doc_id"] for r in langid.keep_language(docs).collect()}
    assert {i for i in got if i < 0} == {-1, -2, -3, -4}
    letters = {r["doc_id"] for r in labelled.collect() if any(map(str.isalpha, r["text"] or ""))}
    assert letters <= got and short.count() > 0


def test_the_stage_learns_from_every_labelled_row(spark):
    out = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [doc(i, "the cat and the dog went with the others") for i in range(20)]
    rows.append(doc(out, "Сегодня утром мы вместе пошли на рынок за свежим хлебом и молоком", "ru"))
    got = langid.keep_language(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["doc_id"] for r in got) == [*range(20), out]


def test_the_stage_keeps_letters_when_nothing_is_learned(spark):
    rows = [doc(1, "some text", None), doc(2, "другой", None), doc(3, "12 !!", None), doc(4, None, None), doc(5, "", "en")]
    assert sorted(r["doc_id"] for r in langid.keep_language(spark.createDataFrame(rows, DOCS)).collect()) == [1, 2]
