"""Page content extraction and attach (T1-T4), pending/needs-content selection.

Pages arrive as a landed table (url, html); fetching is outside Spark. Extraction is
a projection over the page scan (regex built-ins); attaching it to articles is one
equi-join on the link.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import og_image, with_banner_strip, with_main_text
from . import blocks


def extract_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html",
                  landed_col: str | None = None, by_blocks: bool = False) -> DataFrame:
    """T1+T2+T3: (url, image = og:image, content = banner-stripped main text). With
    ``landed_col`` only the newest landing of each URL is extracted; with ``by_blocks`` the main
    text is what ``blocks.main_blocks`` keeps: dense blocks that the host doesn't repeat."""
    p = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("_html"),
                     *([F.col(landed_col).alias("_landed")] if landed_col else []))
    if landed_col:
        newest = p.groupBy("url").agg(F.max("_landed").alias("_landed"))
        p = p.join(newest, ["url", "_landed"]).dropDuplicates(["url"]).drop("_landed")
    p = p.withColumn("image", og_image(F.col("_html")))
    if by_blocks:
        p = blocks.main_blocks(p, "url", "_html").withColumnRenamed("content", "_main")
    else:
        p = with_main_text(p, "_html", "_main")
    return with_banner_strip(p, "_main", "content").select("url", "image", "content")


def attach_content(articles: DataFrame, extracted: DataFrame, compat: bool = True) -> DataFrame:
    """T4: image = existing non-empty image else og:image; content = extracted text.

    ``compat`` (the service's rule) marks every attempted article extracted even when
    nothing came back; otherwise a failed extraction stays retryable and is flagged
    in ``content_error``. Articles already extracted are returned unchanged. Each article
    comes back once: of several extractions of a URL one with content is taken."""
    one = extracted.groupBy(F.col("url").alias("_url")).agg(
        F.max(F.struct(F.col("content").isNotNull().alias("has"), "content", "image")).alias("_x"))
    ex = one.select("_url", F.col("_x.image").alias("_og"), F.col("_x.content").alias("_content"))
    j = articles.join(ex, articles["link"] == ex["_url"], "left")
    todo = ~F.col("content_extracted")
    image = F.when(todo, F.coalesce(F.nullif(F.col("image"), F.lit("")), F.col("_og"))).otherwise(F.col("image"))
    content = F.when(todo, F.col("_content")).otherwise(F.col("content"))
    done = F.lit(True) if compat else (F.col("content_extracted") | F.col("_content").isNotNull())
    out = (j.withColumn("image", image).withColumn("content", content)
           .withColumn("content_extracted", done))
    if not compat:
        out = out.withColumn("content_error", todo & F.col("_content").isNull())
    return out.drop("_url", "_og", "_content")


def pending_extraction(snapshot: DataFrame, limit: int = 10) -> DataFrame:
    """articles not yet extracted, first ``limit`` in snapshot order."""
    return snapshot.where(~F.col("content_extracted")).orderBy("pos").limit(limit)


def needs_content(snapshot: DataFrame, stored: DataFrame, limit: int | None = 60) -> DataFrame:
    """Snapshot articles whose URL has no stored content and that are not yet
    extracted, first ``limit`` in snapshot order (None: all).

    The store is first reduced to the snapshot's links by a semi join; AQE broadcasts them
    while they are few, so a big store is scanned once and not shuffled."""
    links = snapshot.select("link")
    have = (stored.where(F.col("full_content").isNotNull()).select(F.col("url").alias("link"))
            .join(links, "link", "left_semi"))
    todo = snapshot.join(have, "link", "left_anti").where(~F.col("content_extracted"))
    return todo if limit is None else todo.orderBy("pos").limit(limit)
