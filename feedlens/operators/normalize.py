"""Entry normalization (N1-N11, S1 cap): raw feed/sitemap entries -> articles.

One projection over the entries joined to the feed source dimension (AQE broadcasts it
while it is small). Every entry is normalized unless the caller asks for the per-feed cap
(``per_feed``), a ``row_number() <= n`` rank filter that Spark plans as a partial
WindowGroupLimit before the shuffle, so a huge feed is cut map-side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.html import html_image
from ..functions.text import WS, clean_html, col_, is_blank, strip_ws, url_has_lang_prefix
from ..session import cut_lineage, ts_lit
from ..sources import dims

ORD_FEED_SHIFT = 1_000_000_000  # ord = feed_ord * shift + entry_ord (source order, then position)


def cap_per_feed(entries: DataFrame, n: int = dims.MAX_ARTICLES_PER_FEED) -> DataFrame:
    """S1 cap: the first n entries of each feed by position, before any entry is
    dropped as invalid."""
    w = Window.partitionBy("feed_ord").orderBy("entry_ord")
    return entries.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def excluded_by_tag(tags) -> Column:
    """Any tag term, stripped and lowercased, equals 'top bm'."""
    return F.coalesce(F.exists(col_(tags), lambda t: F.lower(strip_ws(F.coalesce(t["term"], F.lit(""))))
                               == dims.EXCLUDED_TAG), F.lit(False))


def infer_category(tags, source_category) -> Column:
    """First tag found in the dictionary, else the source category, else 'general'."""
    hit = F.get(F.filter(F.transform(col_(tags), lambda t: F.try_element_at(
        dims.category_map_expr(), F.lower(strip_ws(F.coalesce(t["term"], F.lit("")))))),
        lambda c: c.isNotNull()), 0)
    return F.coalesce(hit, F.nullif(col_(source_category), F.lit("")), F.lit("general"))


def entry_date(published, pub_date, updated, created, as_of: datetime) -> Column:
    """Published -> pubDate -> updated -> created; a field that fails to parse is
    skipped; none -> ``as_of`` (the run's "now"), which also fills in what a date leaves out."""
    return F.coalesce(*[parse_date(c, as_of) for c in (published, pub_date, updated, created)], ts_lit(as_of))


def entry_description(summary, description, content) -> Column:
    """Summary -> description -> content[0]; first non-empty raw field wins (even if
    it cleans to empty); HTML-cleaned, first 500 chars."""
    s, d = strip_ws(F.coalesce(col_(summary), F.lit(""))), strip_ws(F.coalesce(col_(description), F.lit("")))
    c0 = F.get(col_(content), 0)["value"]
    return (F.when(s != "", F.left(clean_html(s), F.lit(500)))
            .when(d != "", F.left(clean_html(d), F.lit(500)))
            .when(F.coalesce(c0, F.lit("")) != "", F.left(clean_html(c0), F.lit(500))))


def feed_full_content(summary, description, content) -> Column:
    """Same order, but only a field whose raw (stripped) length exceeds 500;
    cleaned, not truncated. Empty result -> null."""
    s, d = strip_ws(F.coalesce(col_(summary), F.lit(""))), strip_ws(F.coalesce(col_(description), F.lit("")))
    c0 = F.coalesce(F.get(col_(content), 0)["value"], F.lit(""))
    out = (F.when(F.length(s) > 500, clean_html(s)).when(F.length(d) > 500, clean_html(d))
           .when(F.length(c0) > 500, clean_html(c0)))
    return F.nullif(out, F.lit(""))


def entry_image(thumbs, media, enclosures, image, content, summary, description) -> Column:
    """thumbnail[0].url (even null) -> first image media item -> first image
    enclosure (href, else url) -> image struct (href, else url) -> first <img> in the
    content values, summary, description."""
    mc = F.filter(col_(media), lambda m: (m["medium"] == "image")
                  | F.coalesce(m["type"], F.lit("")).startswith("image"))
    en = F.filter(col_(enclosures), lambda e: F.coalesce(e["type"], F.lit("")).startswith("image"))
    img = col_(image)
    cands = F.concat(
        F.transform(F.filter(F.coalesce(col_(content), F.array().cast("array<struct<value:string>>")),
                             lambda c: ~is_blank(c["value"])), lambda c: c["value"]),
        F.array(F.when(~is_blank(summary), col_(summary))), F.array(F.when(~is_blank(description), col_(description))))
    from_html = F.get(F.filter(F.transform(F.filter(cands, lambda h: h.isNotNull()), lambda h: html_image(h)),
                               lambda u: u.isNotNull()), 0)
    return (F.when(F.size(col_(thumbs)) > 0, F.get(col_(thumbs), 0)["url"])
            .when(F.size(mc) > 0, F.get(mc, 0)["url"])
            .when(F.size(en) > 0, F.coalesce(F.nullif(F.get(en, 0)["href"], F.lit("")), F.get(en, 0)["url"]))
            .when(img.isNotNull(), F.coalesce(F.nullif(img["href"], F.lit("")), img["url"]))
            .otherwise(from_html))


def _entries_of(entries: DataFrame, per_feed: int | None) -> DataFrame:
    return entries if per_feed is None else cap_per_feed(entries, per_feed)


def normalize_entries(entries: DataFrame, sources: DataFrame, as_of: datetime,
                      per_feed: int | None = None) -> DataFrame:
    """Validated entries -> article rows (with ``ord``); with ``per_feed`` only the
    first so many entries of each feed (S1)."""
    src = sources.select("feed_ord", F.col("name").alias("_src_name"),
                         F.col("category").alias("_src_cat"), "full_content_in_feed")
    e = _entries_of(entries, per_feed).join(src, "feed_ord")
    title, link = strip_ws(F.coalesce("title", F.lit(""))), strip_ws(F.coalesce("link", F.lit("")))
    e = e.where(~excluded_by_tag("tags") & (title != "") & (link != ""))
    full = F.when(F.col("full_content_in_feed"), feed_full_content("summary", "description", "content"))
    return e.select(
        (F.col("feed_ord").cast("long") * ORD_FEED_SHIFT + F.col("entry_ord")).alias("ord"),
        title.alias("title"), link.alias("link"), F.col("_src_name").alias("source"),
        entry_date("published", "pubDate", "updated", "created", as_of).alias("published_at"),
        entry_description("summary", "description", "content").alias("description"),
        entry_image("media_thumbnail", "media_content", "enclosures", "image", "content", "summary",
                    "description").alias("image"),
        infer_category("tags", "_src_cat").alias("category"),
        full.alias("content"), full.isNotNull().alias("content_extracted"))


def normalize_sitemap(items: DataFrame, sources: DataFrame, as_of: datetime,
                      per_feed: int | None = None) -> DataFrame:
    """Sitemap <url> entries: skip two-letter language paths, require loc and a
    title; date default ``as_of``; no description; category = the source's (no
    'general' default)."""
    src = sources.select("feed_ord", F.col("name").alias("_src_name"), F.col("category").alias("_src_cat"))
    e = _entries_of(items, per_feed).join(src, "feed_ord")
    title = strip_ws(F.coalesce("title", F.lit("")))
    loc = F.col("loc")
    e = e.where(loc.isNotNull() & (loc != "") & ~url_has_lang_prefix(loc) & (title != ""))
    pub = F.when(~is_blank("publication_date"), F.coalesce(parse_date("publication_date", as_of), ts_lit(as_of)))
    return e.select(
        (F.col("feed_ord").cast("long") * ORD_FEED_SHIFT + F.col("entry_ord")).alias("ord"),
        title.alias("title"), loc.alias("link"), F.col("_src_name").alias("source"),
        F.coalesce(pub, ts_lit(as_of)).alias("published_at"), F.lit(None).cast("string").alias("description"),
        F.col("image_loc").alias("image"), F.col("_src_cat").alias("category"),
        F.lit(None).cast("string").alias("content"), F.lit(False).alias("content_extracted"))


def resolve_redirects(articles: DataFrame, redirect_map: DataFrame, sources: DataFrame | None = None,
                      host: str = dims.AGGREGATOR_HOST) -> DataFrame:
    """Replace aggregator links (those that name ``host``) by their decoded URL where one
    is known; keep the original otherwise. With ``sources`` only articles of feeds served by
    ``host`` are touched. ``redirect_map`` (link, decoded_url[, ord]) is a landed table; of
    several decodings of a link the first by ``ord`` (else by URL) counts."""
    order = F.col("ord") if "ord" in redirect_map.columns else F.col("decoded_url")
    known = redirect_map.where((F.col("decoded_url") != "") & F.col("link").contains(f"{host}/"))
    r = known.groupBy(F.col("link").alias("_l")).agg(F.min_by("decoded_url", order).alias("decoded_url"))
    gate = F.coalesce(F.col("link").contains(f"{host}/"), F.lit(False))
    a = articles
    if sources is not None:
        served = sources.where(F.col("url").contains(host)).select(F.col("name").alias("_served")).distinct()
        a = a.join(served, a["source"] == served["_served"], "left")
        gate = gate & F.col("_served").isNotNull()
    # most articles have no link of the host: they take no part in the join
    hit, rest = a.where(gate), a.where(~gate)
    found = (hit.join(cut_lineage(r), F.col("link") == F.col("_l"), "left")
             .withColumn("link", F.coalesce("decoded_url", "link")))
    return rest.select(*articles.columns).unionByName(found.select(*articles.columns))


def feed_status(entries: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Per configured feed, articles produced and an error when the feed
    delivered no entries at all (as a failed fetch/parse is reported)."""
    got = entries.groupBy("feed_ord").agg(F.count(F.lit(1)).alias("entries"))
    made = articles.groupBy((F.col("ord") / ORD_FEED_SHIFT).cast("int").alias("feed_ord")) \
        .agg(F.count(F.lit(1)).alias("articles"))
    return (sources.select("feed_ord", "name").join(got, "feed_ord", "left").join(made, "feed_ord", "left")
            .select("feed_ord", "name", F.coalesce("articles", F.lit(0)).cast("long").alias("articles"),
                    F.when(F.col("entries").isNull(), F.concat(F.lit("Failed to parse feed: "), F.col("name")))
                    .alias("error")))
