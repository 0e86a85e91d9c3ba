import corpus_pipeline as cp
from feedlens.llm import langid, simhash, spans
from feedlens.llm.common import load
from test_simhash import brute_roots, plain
from test_spans import brute
from test_tokens import ids
from helpers import awkward, no_docs

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = load(spark, SF, "documents")
    names = docs.columns
    kept = cp.language(spark, docs, SF)
    assert kept.columns == names
    have = {r["doc_id"]: r for r in docs.collect()}
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert all(any(c.isalpha() for c in r["text"]) for r in rows.values())
    assert all(not any(c.isalpha() for c in (have[i]["text"] or "")) for i in set(have) - set(rows))

    one = cp.near_dedup(spark, kept, SF)
    order = sorted(rows)
    roots = brute_roots([plain(rows[i]["text"]) for i in order], simhash.MAX_BITS)
    got = sorted(one.collect())
    assert one.columns == names and [r["doc_id"] for r in got] == sorted({order[r] for r in roots})

    clean = cp.span_dedup(spark, one, SF)
    words, left = brute([r["text"] for r in got], spans.WINDOW)
    want = {r["doc_id"]: b" ".join(x).decode() if len(w) > len(x) else r["text"] for r, w, x in zip(got, words, left)}
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == names and texts == want

    mixed = cp.mix(spark, clean, SF)
    words_in = sum(len(t.encode().split()) for t in texts.values())
    pieces = [r["text"] for r in mixed.collect()]
    assert mixed.columns == names and abs(sum(len(t.encode().split()) for t in pieces) - 1.5 * words_in) < 60

    packed = cp.pack(spark, mixed, SF).collect()
    assert sum(r["length"] for r in packed) == sum(len(ids(t)) + 1 for t in pieces)


def test_run(spark):
    got = cp.run(spark, SF).collect()
    assert got and max(r["length"] for r in got) <= 1024


def test_awkward_rows_pass_every_stage(spark):
    for docs in (awkward(spark), no_docs(spark)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF)
            assert name == "pack" or out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)


def test_clean_documents_stay(spark):
    docs = load(spark, SF, "documents")
    assert langid.keep_language(docs.where("length(text) > 30")).count() >= 0.99 * docs.where("length(text) > 30").count()
