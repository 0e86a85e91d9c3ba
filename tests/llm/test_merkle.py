import hashlib

from feedlens.llm import merkle
from helpers import DOCS, awkward, doc, no_docs


def brute_next(rows):
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), (r["text"] or "").encode()))
    texts = [r["text"] or "" for r in order]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, t, texts[(i + 1) % len(texts)])
                  for i, (r, t) in enumerate(zip(order, texts)))


def test_next_document(spark, monkeypatch):
    docs = awkward(spark, [doc(100 + 7 * i % 90, f"text {i}") for i in range(60)])
    for per_bucket in (2000, 3, 1):
        monkeypatch.setattr(merkle, "ROWS_PER_BUCKET", per_bucket)
        got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["next_text"]) for r in merkle.with_next(docs).collect())
        assert got == brute_next(docs.select("doc_id", "text").collect())


def test_edited_and_likeness(spark):
    texts = ["".join(f"{w}{i} " + ("\n" if j % 9 == 0 else "") for j, w in enumerate("ab cd ef gh ij kl mn op qr st".split() * 12))
             for i in range(6)]
    docs = spark.createDataFrame([doc(i, t) for i, t in enumerate([*texts, texts[0], texts[0]])], DOCS)
    got = {r["doc_id"]: r for r in merkle.edited_pairs(docs).collect()}
    for i in range(1, 6):
        t, m = texts[i], len(texts[i]) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((t[:len(t) - m] + texts[i - 1][:m]).encode()).hexdigest()
        assert 0.5 < got[i]["near_edited"] < 0.8 and got[i]["near_next"] < 0.05
    assert got[7]["near_next"] == 1.0 and got[7]["fingerprint"] == got[6]["fingerprint"] == got[0]["fingerprint"]
    assert len({got[i]["fingerprint"] for i in range(6)}) == 6
    assert all(r["fingerprint"] != r["edited_fingerprint"] for i, r in got.items() if i in range(1, 6))


def test_branches_locate_an_edit(spark):
    lines = [f"line {i}" for i in range(40)]
    left = spark.createDataFrame([doc(1, "\n".join(lines)), doc(2, "same")], DOCS)
    lines[21] = "changed"
    right = spark.createDataFrame([doc(1, "\n".join(lines)), doc(2, "same")], DOCS)
    got = {(r["doc_id"], r["level"], r["position"]) for r in merkle.differing(left, right).collect()}
    assert got == {(1, "root", 0), (1, "section", 2), (1, "paragraph", 21)}
    longer = spark.createDataFrame([doc(1, "\n".join([*lines, "one", "more"])), doc(3, "new"), doc(None, "no id")], DOCS)
    got = {(r["doc_id"], r["level"], r["position"], r["left_digest"] is None, r["right_digest"] is None)
           for r in merkle.differing(right, longer).collect()}
    assert got == {(1, "root", 0, False, False), (1, "section", 5, True, False), (1, "paragraph", 40, True, False),
                   (1, "paragraph", 41, True, False), *((2, x, 0, False, True) for x in ("root", "section", "paragraph")),
                   *((3, x, 0, True, False) for x in ("root", "section", "paragraph"))}
    assert merkle.differing(right, right).count() == 0 and merkle.differing(no_docs(spark), no_docs(spark)).count() == 0


def test_awkward_rows(spark):
    got = merkle.edited_pairs(awkward(spark)).collect()
    assert len(got) == 12 and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    empty = [r for r in got if r["n_chars"] == 0]
    assert len(empty) == 3 and len({r["fingerprint"] for r in empty}) == 1 and empty[0]["near_edited"] == 1.0
    assert merkle.edited_pairs(no_docs(spark)).count() == 0
    assert merkle.edited_pairs(spark.createDataFrame([doc(5, "only one document here")], DOCS)).first()["near_next"] == 1.0
    assert merkle.fingerprints(awkward(spark)).count() == 12
