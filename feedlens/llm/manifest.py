"""Merkle dataset manifest: every row is a leaf, every source a tree, the subroots a tree.

Leaves of a source ascend by doc_id and lie in aligned blocks of ``fanout ** levels`` leaves;
a block is one group of bounded size and hashes its own subtree. Above the blocks there is no
upward pass followed by a downward one but a butterfly exchange: in round r the blocks whose
numbers differ only in digit r (to the base ``fanout``) form a group and swap the roots of
their subtrees. Each member then knows its siblings of that level and hashes the same
ancestor, redundantly. After the last round every block holds its whole upper proof and the
root. Groups have at most ``fanout`` rows, so no source, however large, meets in one task. A
ragged last subtree is filled up with members that carry only its digest ("phantoms", never
more than there are blocks), so each group is complete and no block needs a second source.

Null source: a source of its own, before all others. Null doc_id: before all others; rows that
share a doc_id follow each other by their leaf, then by the tampered leaf; repeated rows are
leaves of their own. Null or empty text: ``-`` and ``0:`` in the leaf's input. Very long texts
are hashed where they are read and never move. Empty tables give no rows. Other columns are
never read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

FANOUT = 16
LEVELS = 3         # levels inside a block: 4096 leaves

STEPS = "array<struct<l:string,r:string>>"   # siblings to the left and right, level by level


def _h(c) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c) -> Column:
    """A value in a leaf's input: ``-`` for null, else its UTF-8 byte count, ``:``, itself."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(text) -> Column:
    """The digest of a row with that text."""
    return _h(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)))


def leaves(docs: DataFrame) -> DataFrame:
    """tree, doc_id, leaf, tampered: the leaf of each row and, for the fifth of the rows whose
    text is lower-cased (A-Z), the leaf after that. ``tree`` orders like source, null first."""
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(F.col("text")).alias("leaf"),
                       F.when(hit, leaf_of(lowered)).alias("tampered"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place (from 0) within ``tree`` by ``order``, and ``size``, the rows of
    the tree. Rows are dealt by ranges and sorted there; a tree's rows in a partition are a
    run, and only one row per run goes through a window."""
    keys = ["tree", *order, "tie"]
    dealt = cut_lineage(rows.withColumn("tie", F.monotonically_increasing_id())
                        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
                        .withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    runs = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    whole = Window.partitionBy("tree").orderBy("part")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    runs = cut_lineage(runs.withColumn("size", F.sum("rows").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                       .withColumn("pos", F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).drop("rows", "first"))
    return dealt.join(runs, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("pos")).drop("at", "part")


def block_levels(digests: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The digests of each level of one block, from the leaves on: ``levels`` levels, or up
    to its root (None)."""
    out = [digests]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([hashlib.sha256("".join(low[i:i + fanout]).encode()).hexdigest() for i in range(0, len(low), fanout)])
    return out


def block_steps(levels: list[list[str]], fanout: int) -> list[list[tuple[str, str]]]:
    """Siblings to the left and right of every node below the top, level by level."""
    out = []
    for nodes in levels[:-1]:
        steps = []
        for i in range(len(nodes)):
            run, at = nodes[i - i % fanout:i - i % fanout + fanout], i % fanout
            steps.append(("".join(run[:at]), "".join(run[at + 1:])))
        out.append(steps)
    return out


def in_order(t: pa.Table) -> pa.Table:
    return t.sort_by("pos")


def block_roots(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tree, block, blocks (of the tree), digest: the roots of the blocks."""
    per = fanout ** levels

    def root(t: pa.Table) -> pa.Table:
        t = in_order(t)
        size = t["size"][0].as_py()
        top = block_levels(t["leaf"].to_pylist(), fanout, levels if size > per else None)[-1][0]
        return pa.table({"tree": [t["tree"][0].as_py()], "block": pa.array([t["pos"][0].as_py() // per], pa.int64()),
                         "blocks": pa.array([-(-size // per)], pa.int64()), "digest": [top]})

    at = F.floor(F.col("pos") / per)
    return (rows.select("tree", "pos", "leaf", "size", at.alias("block")).groupBy("tree", "block")
            .applyInArrow(root, "tree string, block long, blocks long, digest string"))


def exchange(roots: DataFrame, fanout: int) -> DataFrame:
    """The butterfly: tree, block, digest (now the tree's root), steps (the block's upper
    proof). One round per digit of the largest block number, each an aggregate over groups of
    at most ``fanout`` rows."""
    state = cut_lineage(roots.withColumn("steps", F.array().cast(STEPS)).withColumn("real", F.lit(True)))
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while most > span:
        nodes = F.ceil(F.col("blocks") / span)
        done, busy = state.where(nodes <= 1), state.where(nodes > 1)
        member = F.struct(F.floor(F.col("block") / span % fanout).cast("int").alias("digit"), "digest", "steps", "real")
        groups = (busy.groupBy("tree", F.floor(F.col("block") / (span * fanout)).alias("high"), (F.col("block") % span).alias("low"), "blocks")
                  .agg(F.sort_array(F.collect_list(member)).alias("m")))
        groups = groups.withColumn("digests", F.transform("m", lambda x: x["digest"]))

        def swapped(d):
            left = F.array_join(F.slice("digests", 1, d), "")
            right = F.array_join(F.slice("digests", d + 2, F.lit(fanout)), "")
            own = F.get("m", d)
            return F.struct(
                d.alias("digit"), F.coalesce(own["real"], F.lit(False)).alias("real"),
                F.when(own["real"], F.concat(own["steps"], F.array(F.struct(left.alias("l"), right.alias("r"))).cast(STEPS)))
                .otherwise(F.array().cast(STEPS)).alias("steps"))

        last = F.ceil(F.col("blocks") / (span * fanout)) <= 1
        places = F.sequence(F.lit(0), F.when(last, F.size("m") - 1).otherwise(F.lit(fanout - 1)))
        moved = groups.select("tree", "high", "low", "blocks", _h(F.array_join("digests", "")).alias("digest"),
                              F.explode(F.transform(places, swapped)).alias("x"))
        moved = moved.where(~last | F.col("x.real")).select(
            "tree", (F.col("high") * (span * fanout) + F.col("x.digit") * span + F.col("low")).alias("block"),
            "blocks", "digest", "x.steps", "x.real")
        state = cut_lineage(done.unionByName(moved))
        span *= fanout
    return state.where("real").select("tree", "block", "digest", "steps")


def source_proofs(subroots: DataFrame, fanout: int, levels: int) -> DataFrame:
    """tree, above (steps from each subroot to the root), root: the tree over the sources, by
    the same blocks and exchange."""
    rows = cut_lineage(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("digest").alias("leaf")), "name"))
    upper = exchange(block_roots(rows, fanout, levels), fanout)
    per = fanout ** levels

    def steps(t: pa.Table, up: pa.Table) -> pa.Table:
        t, known = in_order(t), up["steps"][0].as_py()
        made = block_levels(t["leaf"].to_pylist(), fanout, levels if t["size"][0].as_py() > per else None)
        lower = block_steps(made, fanout)
        paths = [[{"l": s[i // fanout ** k][0], "r": s[i // fanout ** k][1]} for k, s in enumerate(lower)] + known for i in range(t.num_rows)]
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return pa.table({"tree": t["name"], "above": pa.array(paths, kind), "root": pa.array([up["digest"][0].as_py()] * t.num_rows, pa.string())})

    blocks = rows.withColumn("block", F.floor(F.col("pos") / per))
    return (blocks.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block"))
            .applyInArrow(steps, f"tree string, above {STEPS}, root string"))


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in steps:
        leaf = hashlib.sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the proof of every
    row, and whether the row as it is now (tampered or not) leads to the root.

    Only digests are shuffled: texts are read once, hashed and left. Steps are checkpointed."""
    per = fanout ** levels
    rows = cut_lineage(numbered(cut_lineage(leaves(docs)), "doc_id", "leaf", "tampered"))
    upper = cut_lineage(exchange(block_roots(rows, fanout, levels), fanout))
    above = cut_lineage(source_proofs(upper.where("block = 0").select("tree", "digest"), fanout, levels))
    known = upper.join(above, "tree").select("tree", "block", F.col("digest").alias("subroot"), "root", F.concat("steps", "above").alias("steps"))

    def prove(t: pa.Table, up: pa.Table) -> pa.Table:
        t, top = in_order(t), up.slice(0, 1).to_pylist()[0]
        made = block_levels(t["leaf"].to_pylist(), fanout, levels if t["size"][0].as_py() > per else None)
        lower, rest = block_steps(made, fanout), [(s["l"], s["r"]) for s in top["steps"]]
        proofs, roots = [], []
        for i, (leaf, now) in enumerate(zip(t["leaf"].to_pylist(), t["tampered"].to_pylist())):
            steps = [s[i // fanout ** k] for k, s in enumerate(lower)] + rest
            proofs.append(hashlib.sha256("".join(x + y for x, y in steps).encode()).hexdigest())
            roots.append(fold(now or leaf, steps))
        n = t.num_rows
        return pa.table({"doc_id": t["doc_id"], "leaf": t["leaf"], "subroot": [top["subroot"]] * n, "root": [top["root"]] * n,
                         "proof_sha256": proofs, "folded_root": roots, "verified": [r == top["root"] for r in roots]})

    blocks = rows.withColumn("block", F.floor(F.col("pos") / per))
    return (blocks.groupBy("tree", "block").cogroup(known.groupBy("tree", "block"))
            .applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                 "folded_root string, verified boolean"))


def _tree_sql(name: str, start: str, depth: int) -> str:
    """CTEs of one forest: ``<name>0`` (tree, pos, digest, n) up to ``<name><depth>``, runs of 16."""
    out = [f"{name}0 AS ({start})"]
    for k in range(depth):
        out.append(f"""{name}r{k} AS (SELECT tree, pos // 16 AS run, list(digest ORDER BY pos) AS ds, any_value(n) AS n FROM {name}{k} GROUP BY ALL)""")
        out.append(f"""{name}{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS digest, (n + 15) // 16 AS n FROM {name}r{k})""")
    return ",\n".join(out)


def _steps_sql(name: str, source: str, depth: int, pos: str, tree: str) -> str:
    """CTEs that carry proof and folded up one forest's runs."""
    out, was = [], source
    for k in range(depth):
        out.append(f"""{source}{name}{k} AS (SELECT p.* REPLACE (
    p.proof || CASE WHEN r.n = 1 THEN '' ELSE array_to_string(r.ds[1:a], '') || array_to_string(r.ds[a + 2:], '') END AS proof,
    CASE WHEN r.n = 1 THEN p.folded ELSE sha256(array_to_string(r.ds[1:a], '') || p.folded || array_to_string(r.ds[a + 2:], '')) END AS folded)
  FROM (SELECT *, ({pos} // {16 ** k}) % 16 AS a FROM {was}) p JOIN {name}r{k} r ON r.tree = {tree} AND r.run = p.{pos} // {16 ** (k + 1)})"""
                   .replace("p.* REPLACE", "p.* EXCLUDE (a) REPLACE"))
        was = f"{source}{name}{k}"
    return ",\n".join(out)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                                   for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_DOC_LEVELS, _SOURCE_LEVELS = 6, 4     # 16 ** 6 rows a source, 16 ** 4 sources
_BIT = "CASE WHEN xor(c, v) & 1 = 1 THEN xor(xor(c, v) >> 1, 3988292384::UBIGINT) ELSE xor(c, v) >> 1 END"

ORACLE = f"""
WITH d AS (SELECT *, coalesce('s' || source, '') AS tree, {_leaf_sql("text")} AS leaf,
    xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])),
      lambda c, v: {_BIT}, 4294967295::UBIGINT), 4294967295::UBIGINT) % 5 = 0 AS hit,
    translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS low FROM documents),
x AS (SELECT *, CASE WHEN hit THEN {_leaf_sql("low")} END AS tampered FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, tampered NULLS FIRST) - 1 AS pos,
    count(*) OVER (PARTITION BY tree) AS n FROM x),
{_tree_sql("t", "SELECT tree, pos, leaf AS digest, n FROM l", _DOC_LEVELS)},
s AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM t{_DOC_LEVELS}),
{_tree_sql("u", "SELECT '' AS tree, spot AS pos, subroot AS digest, n FROM s", _SOURCE_LEVELS)},
p AS (SELECT l.doc_id, l.leaf, l.tree, l.pos, s.subroot, s.spot, '' AS proof, coalesce(l.tampered, l.leaf) AS folded FROM l JOIN s ON s.name = l.tree),
{_steps_sql("t", "p", _DOC_LEVELS, "pos", "p.tree")},
q AS (SELECT * FROM pt{_DOC_LEVELS - 1}),
{_steps_sql("u", "q", _SOURCE_LEVELS, "spot", "''")}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified
FROM qu{_SOURCE_LEVELS - 1}, u{_SOURCE_LEVELS}
"""
