"""Mixing sources to target weights (DataFrame functions only).

``water_fill`` clamps sources at ``max_epochs`` times their size and reshares the excess
by weight until none is above; ``cuts`` turns each target into whole repetitions plus a
seeded fractional one; ``mix`` marks the words each document gives to the mix.

Documents of a source are ordered by md5(seed | doc_id). The fractional repetition takes
documents in that order until the words owed are met; the document at the cut gives only
the words still missing, so a source's words meet its target to the word. The cut is
found digit by digit (256 sums per source and level), so no window holds a whole source,
however large. The per-source table is the only thing joined back to the documents.

Defined cases: null or empty text has size 0 and takes 0; a null source is one source,
ranked last; a source without words has target 0; rows that share doc_id and source share
the words at a cut in proportion to their sizes; a null doc_id orders like the text
"null"; a very long text is counted whole in its row and only its size moves; an empty table gives
an empty result. Further columns of the input are kept by
``mix_documents`` and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.upsert import assign_dense_ids
from ..session import cut_lineage

WEIGHTS = (5, 2, 1)     # by source rank, repeating
BUDGET = 1.5            # words in the mix / words there are
MAX_EPOCHS = 2.0        # no source above this many times its size
SEED = "mix-1"
LEVELS = 3              # levels of two hex digits before documents are ordered themselves
BROADCAST_SOURCES = 50_000  # per-source rows above this are joined by shuffle

WORD = r"[^\x20\x09-\x0D]+"


def words(text) -> F.Column:
    """Number of words (null: 0)."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_key(c: str = "source") -> F.Column:
    """Null-safe join key of a source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("n"))


def order_key(seed: str = SEED, c: str = "doc_id") -> F.Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(c).cast("string"), F.lit("null"))).cast("binary"))


def weigh(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight``: ranks by code point, null last, through ``weights`` repeating."""
    named = assign_dense_ids(sources.where(F.col("source").isNotNull()), "source", 0, "rank")
    n = named.count()
    ranked = named.unionByName(sources.where(F.col("source").isNull()).withColumn("rank", F.lit(n + 1).cast("long")),
                               allowMissingColumns=True)
    w = F.array(*[F.lit(float(x)) for x in weights])
    return ranked.withColumn("weight", F.element_at(w, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) -> + target. The water level only rises: each round
    clamps the sources that the level would push over their cap and shares what is left
    among the others. One aggregate of the source table per round, scalars only."""
    src = cut_lineage(sources)
    cap = F.col("source_size") * F.lit(max_epochs)
    total = src.agg(F.sum("source_size"), F.sum("weight")).first()
    level, clamped = 0.0, -1
    if total[0]:
        level = budget * total[0] / total[1]
        while True:
            over = F.col("weight") * F.lit(level) >= cap
            n, capped, free = src.agg(F.count(F.when(over, 1)), F.sum(F.when(over, cap)),
                                      F.sum(F.when(~over, F.col("weight")))).first()
            if n == clamped or not free:
                break
            clamped, level = n, (budget * total[0] - (capped or 0.0)) / free
    return src.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: ``whole`` repetitions, and the place ``cut_u`` in the seeded order where
    the fractional one stops, with ``cut_take`` words still taken there out of ``cut_size``.

    ``sized``: (source, size, u); ``targets``: (source, source_size, target)."""
    key = source_key()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    t = targets.withColumn("k", key).withColumn("whole", whole.cast("long"))
    t = t.withColumn("need", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
    state = cut_lineage(t.select("k", F.lit("").alias("p"), F.col("need")).where("need > 0"))
    hint = F.broadcast if state.count() <= BROADCAST_SOURCES else (lambda df: df)
    docs = sized.select(key.alias("k"), "size", "u").where("size > 0")
    for level in range(LEVELS + 1):
        inside = docs.join(hint(state.select("k", "p", "need")), "k").where(F.col("u").startswith(F.col("p")))
        digit = F.substring("u", 1, 2 * (level + 1)) if level < LEVELS else F.col("u")
        sums = inside.groupBy("k", "need", digit.alias("d")).agg(F.sum("size").alias("here"))
        upto = Window.partitionBy("k").orderBy("d")
        cum = F.sum("here").over(upto)
        at_cut = (sums.withColumn("cum", cum)
                  .where((F.col("cum") >= F.col("need")) & (F.col("cum") - F.col("here") < F.col("need"))))
        left = F.col("need") - F.col("cum") + F.col("here")
        state = cut_lineage(at_cut.select("k", F.col("d").alias("p"), left.alias("need"), "here"))
    state = state.select("k", F.col("p").alias("cut_u"), F.col("need").alias("cut_take"), F.col("here").alias("cut_size"))
    return cut_lineage(t.join(state, "k", "left").select("k", "source_size", "target", "whole", "cut_u", "cut_take", "cut_size"))


def plan(docs: DataFrame, seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized documents, per-source cuts). Sized: doc_id, source, size, u."""
    sized = cut_lineage(docs.select("doc_id", "source", words("text").alias("size"), order_key(seed).alias("u")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return sized, cuts(sized, water_fill(weigh(sources)))


def taken(size, u) -> F.Column:
    """Words a document gives to the mix, from the joined cut columns."""
    part = (F.when(u < F.col("cut_u"), size)
            .when(u == F.col("cut_u"), F.least(size, F.floor(F.col("cut_take") * size / F.col("cut_size")).cast("long")))
            .otherwise(F.lit(0)))
    return (F.col("whole") * size + F.coalesce(part, F.lit(0))).cast("long")


def _hinted(cut: DataFrame) -> DataFrame:
    return F.broadcast(cut) if cut.count() <= BROADCAST_SOURCES else cut


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per input row."""
    sized, cut = plan(docs, seed)
    return (sized.withColumn("k", source_key()).join(_hinted(cut), "k")
            .select("doc_id", "size", "source_size", "target", taken(F.col("size"), F.col("u")).alias("taken")))


def mix_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each document as often as it is taken whole, and once more cut to
    the first words still owed when its share is fractional. Columns as in ``docs``."""
    _, cut = plan(docs, seed)
    cut = cut.select("k", "whole", "cut_u", "cut_take", "cut_size")
    held = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), source_key().alias("k"),
                       words("text").alias("size"), order_key(seed).alias("u"))
    got = held.join(_hinted(cut), "k").withColumn("taken", taken(F.col("size"), F.col("u")))
    got = got.withColumn("part", F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0))
    lengths = F.concat(F.array_repeat(F.lit(None).cast("long"), F.when(F.col("size") > 0, F.floor(
        F.col("taken") / F.col("size"))).otherwise(F.col("whole")).cast("int")),
        F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<long>")))
    rows = got.select("row", F.explode(lengths).alias("head"))
    first = F.array_join(F.slice(F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0)), F.lit(1),
                                 F.col("head").cast("int")), " ")
    return rows.select(*[F.when(F.col("head").isNull(), F.col("row.text")).otherwise(first).alias("text")
                         if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')) AS u FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
          row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rk FROM s GROUP BY source),
w AS (SELECT source, source_size, rk, [5.0, 2.0, 1.0][((rk - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM src),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap,
        sum(2 * source_size) OVER o - 2 * source_size AS below, sum(weight) OVER () - (sum(weight) OVER o - weight) AS free
      FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / weight, rk ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT max((1.5::DOUBLE * (SELECT sum(source_size) FROM w) - below) / free) AS level FROM f),
t AS (SELECT source, source_size, least(cap, weight * level)::DOUBLE AS target FROM f, lv),
n AS (SELECT source, source_size, target,
        CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
g AS (SELECT n.source, u, sum(size)::BIGINT AS here, any_value(round(target)::BIGINT - whole * source_size) AS need
      FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source GROUP BY n.source, u),
c AS (SELECT *, sum(here) OVER (PARTITION BY source ORDER BY u) AS cum FROM g)
SELECT doc_id, size, source_size, target,
  (whole * size + CASE WHEN cum <= need THEN size WHEN cum - here < need
     THEN least(size, floor((need - cum + here) * size / here))::BIGINT ELSE 0 END)::BIGINT AS taken
FROM s JOIN n ON s.source IS NOT DISTINCT FROM n.source
JOIN c ON s.source IS NOT DISTINCT FROM c.source AND s.u = c.u
"""
