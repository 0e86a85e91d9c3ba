"""Keyed upserts and table maintenance.

Parquet tables have no MERGE, so an upsert probes the current table with the keyed batch
(inner join), keeps the other rows (anti join) and adds the unseen keys; the result is
written as a new snapshot (or used directly as a DataFrame).
Within one batch, later rows of a key win (the order of sequential upserts);
"preserved" columns keep the last non-null value instead. Surrogate ids are dense
and assigned in order of first appearance without a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import url_domain
from ..session import cut_lineage
from ..sources.dims import NEW_SOURCE_RELIABILITY
from . import dedup


def latest_per_key(batch: DataFrame, key: list[str], order_col: str,
                   preserve: tuple[str, ...] = ()) -> DataFrame:
    """Collapse a batch to one row per key: the last row by ``order_col``; columns in
    ``preserve`` take the last non-null value. Partial aggregation, no group sorting."""
    others = [c for c in batch.columns if c not in key and c not in preserve]
    aggs = [F.max_by(F.struct(*[F.col(c) for c in others]), F.col(order_col)).alias("_last")]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order_col))).alias(c) for c in preserve]
    out = batch.groupBy(*key).agg(*aggs)
    return out.select(*key, *[F.col(f"_last.{c}").alias(c) for c in others], *preserve)


def upsert(target: DataFrame, batch: DataFrame, key: list[str], preserve: tuple[str, ...] = (),
           keep_target: tuple[str, ...] = ()) -> DataFrame:
    """A batch row replaces the target row of its key (all provided columns,
    nulls included, except ``preserve`` columns which fall back to the old value and
    ``keep_target`` columns which are never overwritten); unseen keys are inserted.
    ``batch`` must hold one row per key (see ``latest_per_key``).

    Written batch-side: the target is probed by the batch (left join), and the batch's unseen
    keys are those that the target, reduced to the batch's keys, doesn't hold. For the usual
    small incremental batch AQE broadcasts the batch, and the target is scanned twice (once
    for its keys only) and never shuffled; a large batch falls back to sort-merge joins."""
    provided = [c for c in batch.columns if c not in key]
    b = batch.select(*key, *[F.col(c).alias(f"_n_{c}") for c in provided])
    probed = target.join(b.withColumn("_hit", F.lit(True)), key, "left")
    found = target.select(*key).join(b.select(*key), key, "left_semi")
    inserted = b.join(found, key, "left_anti")
    hit = F.col("_hit").isNotNull()
    merged_exprs, insert_exprs = [], []
    for c in target.columns:
        dtype = target.schema[c].dataType
        if c in key:
            merged_exprs.append(F.col(c))
            insert_exprs.append(F.col(c))
        elif c not in provided or c in keep_target:
            merged_exprs.append(F.col(c))
            insert_exprs.append((F.col(f"_n_{c}") if c in provided else F.lit(None)).cast(dtype).alias(c))
        elif c in preserve:
            merged_exprs.append(F.coalesce(F.col(f"_n_{c}").cast(dtype), F.col(c)).alias(c))
            insert_exprs.append(F.col(f"_n_{c}").cast(dtype).alias(c))
        else:
            merged_exprs.append(F.when(hit, F.col(f"_n_{c}").cast(dtype)).otherwise(F.col(c)).alias(c))
            insert_exprs.append(F.col(f"_n_{c}").cast(dtype).alias(c))
    return probed.select(*merged_exprs).unionByName(inserted.select(*insert_exprs))


OFFSETS_TO_BROADCAST = 100_000


def assign_dense_ids(new_rows: DataFrame, order_col: str, start_after: int, id_col: str = "id") -> DataFrame:
    """ids start_after+1, start_after+2, ... in ``order_col`` order, computed like
    zipWithIndex: range-partition by order, count rows per partition (one small row
    per partition), add the partition's offset to a local row number. The partitioned
    rows are checkpointed first so the count and the numbering see the same
    partitioning (range bounds come from a sample)."""
    parts = cut_lineage(new_rows.repartitionByRange(order_col).sortWithinPartitions(order_col)
                        .withColumn("_p", F.spark_partition_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    w = Window.partitionBy("_p").orderBy(order_col)
    few = parts.rdd.getNumPartitions() <= OFFSETS_TO_BROADCAST      # one offset per partition
    return (parts.join(F.broadcast(offsets) if few else offsets, "_p")
            .withColumn(id_col, F.lit(start_after) + F.col("_off") + F.row_number().over(w))
            .drop("_p", "_off"))


def upsert_sources(sources: DataFrame, articles: DataFrame) -> DataFrame:
    """Get-or-create a source per article domain. Unseen domains are inserted with
    the first article's source name and reliability 0.5; existing rows never change."""
    a = articles.select(url_domain("link").alias("domain"), "source", "ord")
    first = a.groupBy("domain").agg(F.min_by("source", "ord").alias("name"), F.min("ord").alias("_first"))
    new = first.join(sources.select("domain"), "domain", "left_anti")
    max_id = sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new = assign_dense_ids(new, "_first", int(max_id))
    new = new.select("id", "name", "domain", F.lit(NEW_SOURCE_RELIABILITY).alias("reliability_score"),
                     F.lit(None).cast("string").alias("logo_url"))
    return sources.unionByName(new)


SOURCES_SCHEMA = "id long, name string, domain string, reliability_score double, logo_url string"
ARTICLES_SCHEMA = ("id long, title string, url string, summary string, image_url string, "
                   "published_at timestamp, category string, full_content string, source_id long, "
                   "overall_sentiment double")


def upsert_articles(store: DataFrame, sources: DataFrame, articles: DataFrame) -> DataFrame:
    """U2 (+J1, J2): rename link->url, description->summary, image->image_url; look up
    source_id by domain; keep stored full_content when the new one is null; other
    columns are overwritten (nulls included); overall_sentiment untouched. New URLs
    get dense ids in arrival order."""
    src = sources.select(F.col("domain"), F.col("id").alias("source_id"))
    # the source of each domain is looked up for distinct domains, so no text is shuffled by
    # a key that very many articles share
    domain = articles.select(url_domain("link").alias("domain")).distinct().join(src, "domain", "left")
    rows = articles.select("ord", "title", F.col("link").alias("url"), F.col("description").alias("summary"),
                           F.col("image").alias("image_url"), "published_at", "category",
                           F.col("content").alias("full_content"), url_domain("link").alias("domain"))
    batch = (latest_per_key(rows, ["url"], "ord", preserve=("full_content",)).drop("ord")
             .join(domain, "domain", "left").drop("domain"))
    first_ord = articles.groupBy(F.col("link").alias("url")).agg(F.min("ord").alias("_first"))
    fresh = first_ord.join(store.select("url"), "url", "left_anti")
    max_id = store.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    new_ids = assign_dense_ids(fresh, "_first", int(max_id)).select("url", F.col("id").alias("_new_id"))
    # ids go to the batch (only inserts take them), so the store never joins the id table
    numbered = batch.join(new_ids, "url", "left").withColumnRenamed("_new_id", "id")
    return upsert(store, numbered, ["url"], preserve=("full_content",), keep_target=("id",)).select(*store.columns)


def update_sentiment(store: DataFrame, scores: DataFrame) -> DataFrame:
    """U4: update-only: overall_sentiment = compound for URLs present; no inserts."""
    s = latest_per_key(scores.select("url", "compound", "ord"), ["url"], "ord").select("url", "compound")
    return (store.join(s, "url", "left")
            .withColumn("overall_sentiment", F.coalesce(F.col("compound"), F.col("overall_sentiment")))
            .drop("compound").select(*store.columns))


def upsert_mentions(store: DataFrame, mentions: DataFrame) -> DataFrame:
    """Fold the batch per (article_id, company_id) (D7), then upsert on that key. A stored
    mention keeps its ``created_at``: analysing an article again doesn't move it in time."""
    folded = dedup.fold_mentions(mentions).drop("replacements", "ord")
    return upsert(store, folded.select(*store.columns), ["article_id", "company_id"], keep_target=("created_at",))


def replace_in_snapshot(snapshot: DataFrame, updated: DataFrame) -> DataFrame:
    """Replace snapshot rows by link with updated articles; position and
    snapshot_ts are kept (the first match of a link is the one replaced)."""
    cols = [c for c in snapshot.columns if c not in ("link", "pos", "snapshot_ts", "ord")]
    first = snapshot.groupBy("link").agg(F.min("pos").alias("pos"))
    u = (updated.select("link", *[F.col(c).alias(f"_u_{c}") for c in cols])
         .join(first, "link").withColumn("_hit", F.lit(True)))
    j = snapshot.join(u, ["link", "pos"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(*[F.when(hit, F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c)
                      if c in cols else F.col(c) for c in snapshot.columns])
