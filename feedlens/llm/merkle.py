"""Document fingerprints: a Merkle tree per document (DataFrame functions only).

Levels: a paragraph is a line, a section a run of ``SECTION`` paragraphs, the root hashes
the sections. Below a paragraph, pieces of up to three words are its leaves. Nodes are MD5
digests of what lies below them, so equal roots mean equal texts, and where roots differ
only branches whose digests differ need a look (``differing``).

A fingerprint is written ``root:sections:leaves``: 32 hex digits, 8 per section and 5 per
leaf. ``likeness`` is 1 for equal roots, else Dice's share of common leaves.

Null text is empty: no leaves, one fixed root. Empty tables give no rows, repeated rows
are fingerprinted alike, a very long text is hashed whole in its row (its leaves are one array),
extra columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SECTION = 8        # paragraphs per section
LEAF = 5           # hex digits kept of a leaf
PIECE = r"[^ \n]+(?: [^ \n]+){0,2}[ \n]*"  # up to three words and the white space behind
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 10_000


def _md5(c) -> Column:
    return F.md5(c.cast("binary"))


def paragraphs(text) -> Column:
    """Digests of the lines."""
    return F.transform(F.split(text, "\n"), _md5)


def sections(digests) -> Column:
    """Digests of runs of ``SECTION`` paragraphs."""
    n = F.ceil(F.size(digests) / F.lit(SECTION)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: _md5(F.array_join(
        F.slice(digests, i * SECTION + 1, F.lit(SECTION)), "")))


def leaves(text) -> Column:
    """Short digests of the pieces, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.left(_md5(p), F.lit(LEAF)))


def add_tree(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds ``<into>_sections`` (digests), ``<into>_root`` and ``<into>_leaves``."""
    return (df.withColumn(f"{into}_sections", paragraphs(F.col(text)))
            .withColumn(f"{into}_sections", sections(F.col(f"{into}_sections")))
            .withColumn(f"{into}_root", _md5(F.array_join(f"{into}_sections", "")))
            .withColumn(f"{into}_leaves", leaves(F.col(text))))


def written(into: str) -> Column:
    """The fingerprint string of a tree added by ``add_tree``."""
    short = F.array_join(F.transform(f"{into}_sections", lambda s: F.left(s, F.lit(8))), "")
    return F.concat_ws(":", F.col(f"{into}_root"), short, F.array_join(f"{into}_leaves", ""))


def likeness(a: str, b: str) -> Column:
    """0 to 1, of two trees whose ``_set`` columns hold their distinct leaves."""
    common = F.size(F.array_intersect(f"{a}_set", f"{b}_set"))
    total = F.size(f"{a}_set") + F.size(f"{b}_set")
    return (F.when(F.col(f"{a}_root") == F.col(f"{b}_root"), F.lit(1.0))
            .when(total == 0, F.lit(0.0)).otherwise(2.0 * common / total))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return add_tree(d, "text", "t").select("doc_id", written("t").alias("fingerprint"))


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, level ('root', 'section', 'paragraph'), position, parent, digest."""
    d = docs.select("doc_id", paragraphs(F.coalesce("text", F.lit(""))).alias("p"))
    d = d.withColumn("s", sections(F.col("p")))

    def level(name, pos, parent, digest):
        return F.struct(F.lit(name).alias("level"), pos.alias("position"), parent.alias("parent"), digest.alias("digest"))

    zero = F.lit(0)
    every = F.concat(
        F.array(level("root", zero, zero, _md5(F.array_join("s", "")))),
        F.transform("s", lambda x, i: level("section", i, zero, x)),
        F.transform("p", lambda x, i: level("paragraph", i, F.floor(i / SECTION).cast("int"), x)))
    return d.select("doc_id", F.explode(every).alias("n")).select("doc_id", "n.*")


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Branches where two versions of the same documents differ: doc_id, level, position,
    left_digest, right_digest (null: the branch is missing there). Goes down the tree: sections
    are joined for documents whose roots differ, paragraphs below sections that differ.
    Rows without doc_id have no counterpart and are left out."""
    key = ["doc_id", "level", "position"]

    def compared(a: DataFrame, b: DataFrame, name: str, parents: DataFrame | None = None) -> DataFrame:
        def side(docs: DataFrame, digest: str) -> DataFrame:
            at = nodes(docs).where(F.col("level") == name)
            if parents is not None:
                at = at.join(parents, ["doc_id", "parent"], "left_semi")
            return at.select(*key, F.col("digest").alias(digest))
        both = side(a, "left_digest").join(side(b, "right_digest"), key, "full_outer")
        return cut_lineage(both.where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))))

    left, right = (d.select("doc_id", "text").where("doc_id IS NOT NULL") for d in (left, right))
    roots = compared(left, right, "root")
    left, right = (d.join(roots.select("doc_id"), "doc_id", "left_semi") for d in (left, right))
    changed = compared(left, right, "section")
    lines = compared(left, right, "paragraph", changed.select("doc_id", F.col("position").alias("parent")))
    return roots.unionByName(changed).unionByName(lines)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: the text of the next document by descending doc_id, null
    ids last; after the last comes the first. Rows that share a doc_id follow each other by
    text. Null texts are empty.

    Documents are dealt by ranges of doc_id into buckets of about ``ROWS_PER_BUCKET`` rows
    (bounds from ``percentile_approx``, which returns ids that exist); the row at a bound is
    a guest in the bucket after it, so every window finds its next row inside its bucket."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    n, top = d.agg(F.count(F.lit(1)), F.max("key")).first()
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / ROWS_PER_BUCKET)))
    bounds: list[int] = []
    if buckets > 1:
        at = [i / buckets for i in range(1, buckets)]
        got = d.agg(F.percentile_approx("key", at, 20 * buckets)).first()[0]
        bounds = sorted({int(x) for x in got} - {top})
    step = max(1, math.isqrt(len(bounds)))
    every = F.array(*[F.lit(x) for x in bounds]).cast("array<long>")
    coarse = F.array(*[F.lit(x) for x in bounds[step - 1::step]]).cast("array<long>")
    whole = (F.size(F.filter(coarse, lambda b: b < F.col("key"))) * step).cast("int")
    rest = F.size(F.filter(F.slice(every, F.col("w") + 1, F.lit(step)), lambda b: b < F.col("key")))
    placed = d.withColumn("w", whole).withColumn("bucket", F.col("w") + rest).drop("w")
    here = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    after = F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("guest"))
    first = F.struct(F.lit(0).alias("bucket"), F.lit(True).alias("guest"))
    spots = (F.when(F.col("key").isin(bounds or [None]), F.array(here, after))
             .when(F.col("key") == F.lit(top), F.array(here, first)).otherwise(F.array(here)))
    rows = placed.select("doc_id", "text", "key", F.explode(spots).alias("spot")).select("doc_id", "text", "key", "spot.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "text")
    return (rows.withColumn("next_text", F.lead("text").over(order)).where(~F.col("guest"))
            .select("doc_id", "text", "next_text"))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last third of its code points
    replaced by as many of the next document's first, or all), and their likeness."""
    d = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    m = F.floor(F.col("n_chars") / 3).cast("int")
    d = d.withColumn("m", m).withColumn("edited", F.concat(
        F.left("text", (F.col("n_chars") - F.col("m")).cast("int")), F.left("next_text", F.col("m"))))
    for column, into in (("text", "t"), ("edited", "e"), ("next_text", "x")):
        d = add_tree(d, column, into).withColumn(f"{into}_set", F.array_distinct(f"{into}_leaves"))
    return d.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                    written("t").alias("fingerprint"), written("e").alias("edited_fingerprint"),
                    likeness("t", "e").alias("near_edited"), likeness("t", "x").alias("near_next"))


def _tree_sql(c: str, into: str) -> str:
    return f"""
  SELECT *, array_to_string(list_transform(range(0, ceil(len({into}_p) / 8.0)::BIGINT),
      lambda i: md5(array_to_string({into}_p[i * 8 + 1 : i * 8 + 8], ''))), '') AS {into}_s,
    list_transform(regexp_extract_all({c}, '[^ \\n]+(?: [^ \\n]+){{0,2}}[ \\n]*'), lambda p: left(md5(p), 5)) AS {into}_l
  FROM (SELECT *, list_transform(string_split({c}, chr(10)), lambda p: md5(p)) AS {into}_p FROM """


def _finger_sql(into: str) -> str:
    return (f"md5({into}_s) || ':' || array_to_string(list_transform(range(0, len({into}_s) // 32), "
            f"lambda i: substr({into}_s, (i * 32 + 1)::BIGINT, 8)), '') || ':' || array_to_string({into}_l, '')")


def _near_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a}_s = {b}_s THEN 1.0::DOUBLE WHEN len({a}_l) + len({b}_l) = 0 THEN 0.0::DOUBLE "
            f"ELSE 2.0::DOUBLE * len(list_intersect({a}_l, {b}_l)) "
            f"/ (len(list_distinct({a}_l)) + len(list_distinct({b}_l))) END")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nxt
  FROM documents WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, text)),
e AS (SELECT *, left(text, length(text) - length(text) // 3) || left(nxt, length(text) // 3) AS edited FROM d),
t AS ({_tree_sql("text", "t")} e)), u AS ({_tree_sql("edited", "e")} t)), v AS ({_tree_sql("nxt", "x")} u))
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_finger_sql("t")} AS fingerprint,
  {_finger_sql("e")} AS edited_fingerprint, {_near_sql("t", "e")} AS near_edited, {_near_sql("t", "x")} AS near_next
FROM v
"""
