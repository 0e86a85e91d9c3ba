"""Landed tables and the article/mention views Spark derives from them.

The service we mirror reads RSS/XML feeds, web pages and its own Postgres tables. On
a cluster those arrive as landed parquet; here the driver's tables stand in:

* ``pages``      -> articles (title = <title>, link = url, source = host) and page HTML
* ``documents``  -> articles with content (title = first line, link keyed by content)
* ``events``     -> company mention records (the mention/metric tables)

Every derivation is a projection on the scan, so Catalyst prunes columns and pushes
filters into the parquet reader. Fixture text that the driver tables lack (company
names, consent banners, og:image, <img>) is appended by a deterministic rule on the
row id, the same rule the oracle SQL applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_html, collapse_ws, host_of, strip_ws
from ..session import prepare

ARTICLE_COLUMNS = ["ord", "title", "link", "source", "published_at", "description",
                   "image", "category", "content", "content_extracted"]

# --- fixed values: fixture text appended to driver tables ----------------------------
# documents: suffix chosen by doc_id % 8
DOC_SUFFIXES = (
    " Nvidia Corp rose today.",
    " Shares of MSFT and Microsoft Corporation fell. Apple Inc. said it would respond.",
    "",
    " Amazon Web Services grew! AWS is big. Tesla Motors, Tesla and TSLA moved.",
    " Alphabet Inc. and Google rallied? GOOG too.",
    "",
    " NVDA beat estimates. Nvidia rose. Nvidia rose.",
    " Meta Platforms Inc and facebook and apple were quiet; amazon.com shipped.",
)
# pages: consent banner put at the start of <article>, chosen by page_id % 6
PAGE_BANNERS = (
    "<p>We use cookies to improve your browsing experience.</p><p>Manage preferences</p>"
    "<p>On</p><p>Off</p>",
    "",
    "",
    "<p>This website uses tracking for analytics.</p><p>Accept</p><p>Nothing else here at all today.</p>"
    "<p>x</p><p>y</p><p>z</p><p>Read our privacy policy.</p><p>ok</p>",
    "",
    "",
)
# -------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _hours_after_epoch_2024(n) -> F.Column:
    return F.timestamp_seconds(F.lit(1704067200) + n.cast("long") * 3600)


def page_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with fixture markup: og:image (two attribute orders), <img> forms, banners."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    og = (F.when(pid % 4 == 0, F.concat(F.lit('<meta property="og:image" content="https://img.example/og/'),
                                        pid.cast("string"), F.lit('.jpg">')))
          .when(pid % 4 == 1, F.concat(F.lit("<meta content='https://img.example/og/"),
                                       pid.cast("string"), F.lit(".png' property='og:image'>")))
          .otherwise(F.lit("")))
    img = (F.when(pid % 5 == 0, F.concat(F.lit('<img src="//cdn.example/p'), pid.cast("string"),
                                         F.lit('.jpg" alt="x">')))
           .when(pid % 5 == 1, F.concat(F.lit('<img alt="y" srcset="https://cdn.example/p'),
                                        pid.cast("string"), F.lit('-320.jpg 320w, https://cdn.example/p'),
                                        pid.cast("string"), F.lit('-640.jpg 640w">')))
           .when(pid % 5 == 2, F.concat(F.lit("<img data-src=' /img/"), pid.cast("string"),
                                        F.lit(".png '>")))
           .otherwise(F.lit("")))
    banner = F.element_at(F.array(*[F.lit(b) for b in PAGE_BANNERS]), (pid % 6 + 1).cast("int"))
    html = F.replace(F.col("html"), F.lit("</head>"), F.concat(og, F.lit("</head>")))
    html = F.replace(html, F.lit("<article>"), F.concat(F.lit("<article>"), banner, img))
    return p.select("page_id", "url", html.alias("html"))


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as a feed would deliver them for each landed page (no content yet)."""
    p = table(spark, sf_dir, "pages")
    title = collapse_ws(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_extract("html", r"(?is)<article[^>]*>(.*?)</article>", 1)
    return p.select(
        F.col("page_id").alias("ord"),
        title.alias("title"),
        F.col("url").alias("link"),
        host_of("url").alias("source"),
        _hours_after_epoch_2024(F.col("page_id") % 97).alias("published_at"),
        F.left(clean_html(body), F.lit(500)).alias("description"),
        F.lit(None).cast("string").alias("image"),
        F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("string").alias("content"),
        F.lit(False).alias("content_extracted"),
    )


def doc_link(text) -> F.Column:
    return F.concat(F.lit("https://docs.example/"), F.md5(F.lower(text)))


def doc_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose content is a document; the URL is keyed by the lowered text."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("ord"),
        strip_ws(F.substring_index("text", "\n", 1)).alias("title"),
        doc_link(F.col("text")).alias("link"),
        F.col("source"),
        _hours_after_epoch_2024(F.col("doc_id") % 89).alias("published_at"),
        F.left(collapse_ws("text"), F.lit(500)).alias("description"),
        F.lit(None).cast("string").alias("image"),
        F.col("lang").alias("category"),
        F.col("text").alias("content"),
        F.lit(True).alias("content_extracted"),
    )


def doc_mention_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a company-name fixture sentence appended (doc_id % 8)."""
    return docs_to_mention_texts(table(spark, sf_dir, "documents"))


def docs_to_mention_texts(d: DataFrame) -> DataFrame:
    """Projection documents -> (article_id, title, text, source) (batch or stream)."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in DOC_SUFFIXES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("article_id"),
                    strip_ws(F.substring_index("text", "\n", 1)).alias("title"),
                    F.concat(F.col("text"), suffix).alias("text"),
                    F.col("source"))


def event_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mention records from events, in arrival order ``ord``."""
    return events_to_mentions(table(spark, sf_dir, "events"))


def events_to_mentions(e: DataFrame) -> DataFrame:
    """Projection events -> mention records (batch or stream)."""
    conf = F.regexp_extract("props", r"([0-9]+)", 1).cast("int") / F.lit(100.0)
    sent = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("value") - 50.0) / 50.0))
    return e.select(
        F.col("event_id").alias("ord"),
        (F.col("event_id") % 500).alias("article_id"),
        (F.col("user_id") % 7 + 1).alias("company_id"),
        sent.alias("sentiment_score"),
        conf.alias("confidence_score"),
        F.concat(F.col("event_type"), F.lit(" event "), F.col("event_id").cast("string")).alias("context_sentence"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
