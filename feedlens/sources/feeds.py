"""Feed entry sources (S1, S2): landed RSS/Atom and news-sitemap XML, and the raw-entry
view Spark derives from the driver's ``pages`` table.

XML is read with Spark's built-in XML source and an explicit schema (no inference
pass over 100 TB). Entry order, which the service relies on ("first wins"), is the
position of the item in its file: ``_metadata.file_path`` + a per-file row number
over ``monotonically_increasing_id()`` taken right after the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables as S

RAW_ITEM_SCHEMA = T.StructType([
    T.StructField("feed_ord", T.IntegerType()),
    T.StructField("entry_ord", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("content", T.ArrayType(T.StructType([T.StructField("value", T.StringType())]))),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("term", T.StringType())]))),
    T.StructField("media_thumbnail", T.ArrayType(T.StructType([T.StructField("url", T.StringType())]))),
    T.StructField("media_content", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()), T.StructField("medium", T.StringType()),
        T.StructField("type", T.StringType())]))),
    T.StructField("enclosures", T.ArrayType(T.StructType([
        T.StructField("href", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("type", T.StringType())]))),
    T.StructField("image", T.StructType([T.StructField("href", T.StringType()),
                                         T.StructField("url", T.StringType())])),
])

# RSS <item> as the XML source sees it (attributes are prefixed with "_").
RSS_ITEM_XML_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("pubDate", T.StringType()),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("content:encoded", T.StringType()),
    T.StructField("category", T.ArrayType(T.StringType())),
    T.StructField("media:thumbnail", T.ArrayType(T.StructType([T.StructField("_url", T.StringType())]))),
    T.StructField("media:content", T.ArrayType(T.StructType([
        T.StructField("_url", T.StringType()), T.StructField("_medium", T.StringType()),
        T.StructField("_type", T.StringType())]))),
    T.StructField("enclosure", T.ArrayType(T.StructType([
        T.StructField("_url", T.StringType()), T.StructField("_type", T.StringType())]))),
    # RSS 1.0 and Dublin Core
    T.StructField("dc:date", T.StringType()),
    T.StructField("dc:subject", T.ArrayType(T.StringType())),
    T.StructField("dcterms:issued", T.StringType()),
    T.StructField("dcterms:modified", T.StringType()),
    T.StructField("dcterms:created", T.StringType()),
    T.StructField("created", T.StringType()),
    # an image's address is an attribute, a child or the text itself
    T.StructField("image", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_href", T.StringType()),
                                         T.StructField("url", T.StringType())])),
    T.StructField("itunes:image", T.StructType([T.StructField("_href", T.StringType())])),
])

SITEMAP_XML_SCHEMA = T.StructType([
    T.StructField("loc", T.StringType()),
    T.StructField("news:news", T.StructType([
        T.StructField("news:title", T.StringType()),
        T.StructField("news:publication_date", T.StringType())])),
    T.StructField("image:image", T.ArrayType(T.StructType([T.StructField("image:loc", T.StringType())]))),
])

# Atom <entry>; text constructs may carry attributes, so each is a struct with its value.
_ATOM_TEXT = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_type", T.StringType())])
ATOM_ENTRY_XML_SCHEMA = T.StructType([
    T.StructField("title", _ATOM_TEXT),
    T.StructField("link", T.ArrayType(T.StructType([
        T.StructField("_href", T.StringType()), T.StructField("_rel", T.StringType()),
        T.StructField("_type", T.StringType())]))),
    T.StructField("published", T.StringType()),
    T.StructField("issued", T.StringType()),
    T.StructField("updated", T.StringType()),
    T.StructField("modified", T.StringType()),
    T.StructField("created", T.StringType()),
    T.StructField("dc:date", T.StringType()),
    T.StructField("dc:subject", T.ArrayType(T.StringType())),
    T.StructField("summary", _ATOM_TEXT),
    T.StructField("content", _ATOM_TEXT),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
    T.StructField("media:thumbnail", T.ArrayType(T.StructType([T.StructField("_url", T.StringType())]))),
    T.StructField("media:content", T.ArrayType(T.StructType([
        T.StructField("_url", T.StringType()), T.StructField("_medium", T.StringType()),
        T.StructField("_type", T.StringType())]))),
])


def _positions(df: DataFrame) -> DataFrame:
    """file path + position of each row inside its file (scan order).

    Rows are numbered inside their (file, block); the rows of the blocks before are added
    from a table with one row per block, so a large file isn't sorted in one task. The id
    grows with the row inside a task, and a block is read by one task."""
    from ..session import cut_lineage
    df = cut_lineage(df.withColumn("_file", F.col("_metadata.file_path"))
                     .withColumn("_blk", F.col("_metadata.file_block_start"))
                     .withColumn("_mid", F.monotonically_increasing_id()))
    before = Window.partitionBy("_file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (df.groupBy("_file", "_blk").agg(F.count(F.lit(1)).alias("_n"))
              .select("_file", "_blk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    here = Window.partitionBy("_file", "_blk").orderBy("_mid")
    return (df.join(blocks, ["_file", "_blk"])
            .withColumn("entry_ord", (F.col("_before") + F.row_number().over(here) - 1).cast("long"))
            .drop("_mid", "_blk", "_before"))


def _with_feed_ord(x: DataFrame, feed_files: DataFrame | None) -> DataFrame:
    """Joins the feed of each file; by default files sorted by name are feeds 0, 1, ..."""
    if feed_files is None:
        from ..operators.upsert import assign_dense_ids
        feed_files = (assign_dense_ids(x.select("_file").distinct(), "_file", -1, id_col="feed_ord")
                      .select("_file", F.col("feed_ord").cast("int")))
    return x.join(feed_files, "_file")  # AQE broadcasts it when the file list is small


def _media(x: Column) -> list[Column]:
    return [F.transform(x["media:thumbnail"], lambda m: F.struct(m["_url"].alias("url"))).alias("media_thumbnail"),
            F.transform(x["media:content"], lambda m: F.struct(m["_url"].alias("url"), m["_medium"].alias("medium"),
                                                              m["_type"].alias("type"))).alias("media_content")]


def _terms(*lists: Column) -> Column:
    """Tags from lists of terms; null where there is none of the lists."""
    some = F.coalesce(*lists).isNotNull()
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.when(some, F.transform(every, lambda t: F.struct(t.alias("term")))).alias("tags")


def _rss_fields(x: Column) -> list[Column]:
    """Raw entry fields of a parsed RSS item (``RSS_ITEM_XML_SCHEMA``); Dublin Core stands in
    for the dates and categories that RSS 1.0 lacks."""
    content = F.when(x["content:encoded"].isNotNull(), F.array(F.struct(x["content:encoded"].alias("value"))))
    text = F.nullif(F.trim(x["image"]["_VALUE"]), F.lit(""))
    href = F.coalesce(x["image"]["_href"], x["itunes:image"]["_href"])
    url = F.coalesce(F.nullif(F.trim(x["image"]["url"]), F.lit("")), text)
    return [
        x["title"].alias("title"), x["link"].alias("link"), F.coalesce(x["published"], x["dcterms:issued"]).alias("published"), x["pubDate"].alias("pubDate"),
        F.coalesce(x["updated"], x["dcterms:modified"], x["dc:date"]).alias("updated"), F.coalesce(x["created"], x["dcterms:created"]).alias("created"),
        x["summary"].alias("summary"), x["description"].alias("description"), content.alias("content"), _terms(x["category"], x["dc:subject"]), *_media(x),
        F.transform(x["enclosure"], lambda e: F.struct(F.lit(None).cast("string").alias("href"), e["_url"].alias("url"), e["_type"].alias("type"))).alias("enclosures"),
        F.when(href.isNotNull() | url.isNotNull(), F.struct(href.alias("href"), url.alias("url"))).alias("image")]


def _atom_fields(x: Column) -> list[Column]:
    """The same of a parsed Atom entry. The link is the alternate one (no ``rel`` means
    alternate), else the first; links with rel ``enclosure`` are enclosures."""
    usual = F.filter(x["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
    text = x["content"]["_VALUE"]
    return [
        x["title"]["_VALUE"].alias("title"), F.coalesce(F.get(usual, 0)["_href"], F.get(x["link"], 0)["_href"]).alias("link"),
        F.coalesce(x["published"], x["issued"]).alias("published"), F.lit(None).cast("string").alias("pubDate"),
        F.coalesce(x["updated"], x["modified"], x["dc:date"]).alias("updated"), x["created"].alias("created"),
        x["summary"]["_VALUE"].alias("summary"), F.lit(None).cast("string").alias("description"),
        F.when(text.isNotNull(), F.array(F.struct(text.alias("value")))).alias("content"),
        _terms(F.transform(x["category"], lambda c: c["_term"]), x["dc:subject"]), *_media(x),
        F.transform(F.filter(x["link"], lambda k: k["_rel"] == "enclosure"), lambda k: F.struct(
            k["_href"].alias("href"), F.lit(None).cast("string").alias("url"), k["_type"].alias("type"))).alias("enclosures"),
        F.lit(None).cast("struct<href:string,url:string>").alias("image")]


def _read_xml(spark: SparkSession, path, tag: str, schema: T.StructType, feed_files: DataFrame | None) -> DataFrame:
    x = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").schema(schema).load(path)
    x = _with_feed_ord(_positions(x), feed_files)
    return x.select("feed_ord", "entry_ord", F.struct(*[F.col(f"`{f.name}`") for f in schema]).alias("x"))


def read_rss(spark: SparkSession, path: str, feed_files: DataFrame | None = None) -> DataFrame:
    """Landed RSS (0.9x, 1.0, 2.0) files -> raw entries. ``feed_files`` maps file path -> feed_ord."""
    x = _read_xml(spark, path, "item", RSS_ITEM_XML_SCHEMA, feed_files)
    return x.select("feed_ord", "entry_ord", *_rss_fields(F.col("x")))


def read_atom(spark: SparkSession, path: str, feed_files: DataFrame | None = None) -> DataFrame:
    """Landed Atom files -> raw entries in the same shape. An entry without ``published`` is
    dated by ``updated``."""
    x = _read_xml(spark, path, "entry", ATOM_ENTRY_XML_SCHEMA, feed_files)
    return x.select("feed_ord", "entry_ord", *_atom_fields(F.col("x")))


ENTRY = r"(?s)(<(?:item|entry)(?:\s[^>]*)?>.*?</(?:item|entry)\s*>)"


def feed_entries(files: DataFrame) -> DataFrame:
    """Whole feed files (_file, value), batch or stream -> _file, entry_ord and the raw entry
    fields. RSS and Atom entries are found in one pass, in the order of the file, and each is
    parsed by itself (``from_xml``), so a broken entry costs no other. A feed is one row: as a
    feed holds its newest entries only, that is small; dumps of any size go through ``read_rss``."""
    e = files.select("_file", F.posexplode(F.regexp_extract_all("value", F.lit(ENTRY), F.lit(1))).alias("entry_ord", "_xml"))
    rss = F.col("_xml").startswith("<item")
    parse = lambda schema: F.from_xml(F.col("_xml"), schema, {"mode": "PERMISSIVE"})
    e = e.withColumn("_rss", F.when(rss, parse(RSS_ITEM_XML_SCHEMA))).withColumn("_atom", F.when(~rss, parse(ATOM_ENTRY_XML_SCHEMA)))
    fields = F.when(rss, F.struct(*_rss_fields(F.col("_rss")))).otherwise(F.struct(*_atom_fields(F.col("_atom"))))
    return e.select("_file", F.col("entry_ord").cast("long").alias("entry_ord"), fields.alias("e")).select("_file", "entry_ord", "e.*")


def read_feeds(spark: SparkSession, path, feed_files: DataFrame) -> DataFrame:
    """RSS and Atom files together, each read once."""
    paths = path if isinstance(path, list) else [path]
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), "value")
    return feed_entries(files).join(feed_files, "_file").drop("_file")


def read_sitemap(spark: SparkSession, path: str, feed_ord: int | DataFrame) -> DataFrame:
    """Landed news-sitemap files -> sitemap entries (loc, title, date, image). ``feed_ord``
    is the feed of all files, or a table that maps file path -> feed_ord."""
    x = (spark.read.format("xml").option("rowTag", "url").schema(SITEMAP_XML_SCHEMA).load(path))
    x = _positions(x)
    x = x.withColumn("feed_ord", F.lit(feed_ord).cast("int")) if isinstance(feed_ord, int) else _with_feed_ord(x, feed_ord)
    return x.select("feed_ord", "entry_ord", "loc",
                    F.col("`news:news`.`news:title`").alias("title"),
                    F.col("`news:news`.`news:publication_date`").alias("publication_date"),
                    F.get(F.col("`image:image`"), 0)["image:loc"].alias("image_loc"))


# --- raw entries derived from the driver's pages table -----------------------------------

def raw_items_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One raw feed entry per page, spread over the first 4 configured feeds (the other
    six deliver nothing, like failed fetches), exercising every branch of entry
    normalization (blank fields, date formats, tags, images, the per-feed cap)."""
    p = S.table(spark, sf, "pages")
    pid = F.col("page_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + pid * 3600)
    s_pid = pid.cast("string")
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    body = F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)
    m6 = pid % 6
    form = F.floor(pid / 6) % 8
    forms = ["EEE, dd MMM yyyy HH:mm:ss '+0000'", "EEE, dd MMM yyyy HH:mm:ss 'EST'", "dd MMM yyyy HH:mm '+0100'",
             "EEEE, dd MMMM yyyy HH:mm:ss 'GMT'", "EEE, dd MMM yy HH:mm:ss '+0000'", "EEE, dd MMM yyyy HH:mm:ss '+00:00'",
             "MMM d, yyyy HH:mm", "yyyy/MM/dd HH:mm:ss"]
    by_form = F.coalesce(*[F.when(form == i, F.date_format(ts, f)) for i, f in enumerate(forms)])
    published = (F.when(m6 == 0, by_form)
                 .when((m6 == 1) & (F.floor(pid / 6) % 2 == 1), F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
                 .when(m6 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
                 .when(m6 == 2, F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"),
                                         F.lit("+02:00")))
                 .when(m6 == 3, F.lit("not a date"))
                 .when(m6 == 5, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
    pub_date = F.when(m6 == 3, F.concat(F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))
    updated = F.when((m6 == 4) & (pid % 4 != 0), F.date_format(ts, "yyyy-MM-dd")).when(m6 == 4, F.lit("garbage"))
    m11 = pid % 11
    tag = lambda *terms: F.array(*[F.struct(F.lit(t).cast("string").alias("term")) for t in terms])
    tags = (F.when(m11 == 0, tag(" Top BM ", "tech")).when(m11 == 1, tag(" Tech ", "science"))
            .when(m11 == 2, tag("unknown", "Venture Capital")).when(m11 == 3, F.array().cast(
                "array<struct<term:string>>")).when(m11 == 5, tag(None, "F1")).when(m11 != 4, tag("misc")))
    m7 = pid % 7
    thumb = (F.when(m7 == 0, F.array(F.struct(F.concat(F.lit("https://img.example/t"), s_pid, F.lit(".jpg"))
                                               .alias("url"))))
             .when(m7 == 1, F.array(F.struct(F.lit(None).cast("string").alias("url")))))
    mc = F.when(m7 == 2, F.array(
        F.struct(F.lit("https://img.example/v.mp4").alias("url"), F.lit("video").alias("medium"),
                 F.lit("video/mp4").alias("type")),
        F.struct(F.concat(F.lit("https://img.example/m"), s_pid, F.lit(".jpg")).alias("url"),
                 F.lit(None).cast("string").alias("medium"), F.lit("image/jpeg").alias("type"))))
    enc = F.when(m7 == 3, F.array(F.struct(F.lit(None).cast("string").alias("href"),
                                           F.concat(F.lit("https://img.example/e"), s_pid, F.lit(".gif")).alias("url"),
                                           F.lit("image/gif").alias("type"))))
    image = F.when(m7 == 4, F.struct(F.concat(F.lit("https://img.example/h"), s_pid, F.lit(".png")).alias("href"),
                                     F.lit(None).cast("string").alias("url")))
    m5 = pid % 5
    content = (F.when(m5 == 0, F.array(F.struct(body.alias("value"))))
               .when(m5 == 1, F.array(F.struct(F.concat(F.lit('<img src="//cdn.example/c'), s_pid,
                                                        F.lit('.png">short')).alias("value")))))
    m3 = pid % 3
    return p.select(
        (pid % 4).cast("int").alias("feed_ord"), F.floor(pid / 4).cast("long").alias("entry_ord"),
        F.when(pid % 13 == 0, F.lit("  ")).otherwise(title).alias("title"),
        F.when(pid % 17 == 0, F.lit("")).when(pid % 17 == 1, F.concat(F.lit(" "), F.col("url"), F.lit("\n")))
        .otherwise(F.col("url")).alias("link"),
        published.alias("published"), pub_date.alias("pubDate"), updated.alias("updated"),
        F.lit(None).cast("string").alias("created"),
        F.when(m3 == 0, body).when(m3 == 1, F.lit("   ")).alias("summary"),
        F.when(pid % 2 == 0, F.concat(F.lit("<p>"), title, F.lit("</p>"))).alias("description"),
        content.alias("content"), tags.alias("tags"), thumb.alias("media_thumbnail"),
        mc.alias("media_content"), enc.alias("enclosures"), image.alias("image"))


def sitemap_items_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """News-sitemap entries (one per page) for the sitemap path."""
    p = S.table(spark, sf, "pages")
    pid = F.col("page_id")
    ts = F.timestamp_seconds(F.lit(1704067200) + pid * 3600)
    loc = F.when(pid % 3 == 0, F.regexp_replace("url", "(://[^/]+)/[a-z]{2}/", "$1/news/")).otherwise(F.col("url"))
    return p.select(F.lit(10).cast("int").alias("feed_ord"), pid.alias("entry_ord"), loc.alias("loc"),
                    F.when(pid % 9 == 0, F.lit(" ")).otherwise(
                        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
                    F.when(pid % 4 != 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("publication_date"),
                    F.when(pid % 3 == 0, F.concat(F.lit("https://img.example/s"), pid.cast("string"),
                                                  F.lit(".jpg"))).alias("image_loc"))
