import hashlib
import zlib

import pytest
from feedlens.llm import manifest
from helpers import DOCS, awkward, doc, no_docs


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, fanout):
    """(root, siblings of each leaf level by level) the plain way."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            lo = i - i % fanout
            path.append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + fanout])))
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def plain(rows, fanout):
    trees = {}
    for r in rows:
        own, now = leaf(r, r["text"]), ""
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            low = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            now = leaf(r, low)
        trees.setdefault((r["source"] is not None, (r["source"] or "").encode()), []).append(
            (r["doc_id"] is not None, r["doc_id"] or 0, own, now))
    names = sorted(trees)
    made = {n: tree([x[2] for x in sorted(trees[n])], fanout) for n in names}
    root, above = tree([made[n][0] for n in names], fanout)
    out = []
    for n, up in zip(names, above):
        subroot, paths = made[n]
        for (known, doc_id, own, now), path in zip(sorted(trees[n]), paths):
            steps, at = path + up, now or own
            for left, right in steps:
                at = h(left + at + right)
            out.append((doc_id if known else None, own, subroot, root, h("".join(x + y for x, y in steps)), at, at == root))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[1:])


@pytest.mark.parametrize("fanout,levels", [(16, 3), (2, 1), (3, 1), (2, 2)])
def test_proofs_equal_the_plain_tree(spark, fanout, levels):
    """Ragged trees of every height: sources of 1 to 40 rows, one row and repeated rows too."""
    sizes = {"a": 40, "b": 1, "c": 9, "d": 17, None: 5, "ä": 2, "e": 33}
    more = [doc(1000 * k + i, f"Text {i} OF {s} Ä", "en", s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    docs = awkward(spark, more).repartition(5)
    got = sorted((tuple(r) for r in manifest.manifest(docs, fanout, levels).collect()), key=key)
    want = sorted(plain(docs.collect(), fanout), key=key)
    assert got == want
    assert {r[6] for r in got} == {True, False}


def test_a_source_with_most_rows_meets_in_no_task(spark):
    """Groups of the exchange never hold over ``fanout`` rows, blocks never over a block."""
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('T', id) AS text", "'x' AS lang",
                                       "if(id < 250, 'hot', concat('s', id)) AS source", "5L AS n_chars")
    rows = manifest.numbered(manifest.leaves(docs), "doc_id", "leaf", "tampered")
    assert rows.groupBy("tree", (rows.pos / 8).cast("int")).count().agg({"count": "max"}).first()[0] == 8
    roots = manifest.block_roots(rows, 2, 3)
    assert roots.where("tree = 'shot'").count() == 32
    ends = manifest.exchange(roots, 2).where("tree = 'shot'").collect()
    assert len(ends) == 32 and len({r["digest"] for r in ends}) == 1 and {len(r["steps"]) for r in ends} == {5}


def test_only_the_changed_rows_fail(spark):
    docs = spark.createDataFrame([doc(i, f"Capital {i}" if i % 2 else f"small {i}") for i in range(60)], DOCS)
    for r in manifest.manifest(docs).collect():
        hit = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] % 2 == 1
        assert r["verified"] == (not hit)


def test_edge_tables(spark):
    assert manifest.manifest(no_docs(spark)).count() == 0
    one = manifest.manifest(spark.createDataFrame([doc(4, "Only")], DOCS)).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["proof_sha256"] == h("")
    same = manifest.manifest(spark.createDataFrame([doc(7, "Same")] * 40, DOCS)).collect()
    assert len(same) == 40 and len({r["leaf"] for r in same}) == 1 and len({r["root"] for r in same}) == 1
    long = "Very Long " * 400_000
    got = manifest.manifest(spark.createDataFrame([doc(1, long), doc(2, None)], DOCS)).collect()
    assert {r["leaf"] for r in got} == {leaf({"doc_id": 1, "source": "a", "lang": "en", "n_chars": len(long)}, long),
                                        leaf({"doc_id": 2, "source": "a", "lang": "en", "n_chars": None}, None)}
