"""Registered queries: one Spark plan per operator, each with its DuckDB twin.

Every query reads the driver's tables (or what Spark derives from them) in full.
Timestamps leave as ISO strings and doubles are rounded to 9 places in both engines
so the comparison does not depend on client-side type mapping or summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import oracle as O
from ..functions import html as H
from ..functions import text as X
from ..operators import blocks as BL
from ..operators import content, dedup, mentions, scoring
from ..sources import tables as S

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ts_str(c) -> F.Column:
    return F.date_format(X.col_(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def r9(c) -> F.Column:
    return F.round(X.col_(c), 9)


# ---------------------------------------------------------------------------- keys ----

@register("normalize_url", f"SELECT page_id, {O.normalize_url('url')} AS url_key FROM pages")
def q_normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    return S.table(spark, sf, "pages").select("page_id", X.normalize_url("url").alias("url_key"))


@register("normalize_title", f"SELECT ord, {O.normalize_title('title')} AS title_key FROM ({O.page_articles_sql()})")
def q_normalize_title(spark, sf):
    return S.page_articles(spark, sf).select("ord", X.normalize_title("title").alias("title_key"))


@register("fingerprint", f"SELECT page_id, md5({O.normalize_url('url')}) AS fingerprint FROM pages")
def q_fingerprint(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.fingerprint("url").alias("fingerprint"))


@register("url_domain", f"SELECT page_id, {O.url_domain('url')} AS domain FROM pages")
def q_url_domain(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.url_domain("url").alias("domain"))


ROUTED_URL_SQL = ("CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '://[^/]+', '://www.reuters.com') "
                  "WHEN 1 THEN regexp_replace(url, '://[^/]+', '://feeds.arstechnica.com') "
                  "WHEN 2 THEN regexp_replace(url, '://[^/]+', '://notreuters.com') ELSE url END")


def routed_url() -> F.Column:
    pid = F.col("page_id")
    return (F.when(pid % 7 == 0, F.regexp_replace("url", "://[^/]+", "://www.reuters.com"))
            .when(pid % 7 == 1, F.regexp_replace("url", "://[^/]+", "://feeds.arstechnica.com"))
            .when(pid % 7 == 2, F.regexp_replace("url", "://[^/]+", "://notreuters.com"))
            .otherwise(F.col("url")))


def _route_sql() -> str:
    from ..sources.dims import BROWSER_REQUIRED_DOMAINS
    h = f"regexp_replace(lower({O.netloc('u')}), '\\Awww\\.', '')"
    conds = " OR ".join(f"{h} = {O.q(d)} OR ends_with({h}, {O.q('.' + d)})" for d in BROWSER_REQUIRED_DOMAINS)
    return f"SELECT page_id, u AS url, ({conds}) AS browser_required FROM (SELECT page_id, {ROUTED_URL_SQL} AS u FROM pages)"


@register("domain_suffix_match", _route_sql())
def q_domain_suffix_match(spark, sf):
    from ..sources.dims import BROWSER_REQUIRED_DOMAINS
    p = S.table(spark, sf, "pages").select("page_id", routed_url().alias("url"))
    return p.select("page_id", "url", X.host_matches_any("url", BROWSER_REQUIRED_DOMAINS).alias("browser_required"))


@register("clean_html", f"SELECT page_id, {O.clean_html('html')} AS text FROM pages")
def q_clean_html(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", X.clean_html("html").alias("text"))


# ---------------------------------------------------------------------------- dedup ---

def _kept_sql(src: str, ord_expr: str = "ord") -> str:
    return O.greedy_keep_sql(O.dedup_keys_sql(src, ord_expr))


@register("dedup_articles",
          _kept_sql(O.doc_articles_sql()) +
          f"\nSELECT a.ord, a.title, a.link, a.source FROM ({O.doc_articles_sql()}) a JOIN kept USING (ord)")
def q_dedup_articles(spark, sf):
    return dedup.dedup_articles(S.doc_articles(spark, sf)).select("ord", "title", "link", "source")


@register("dedup_pages",
          _kept_sql(O.page_articles_sql()) +
          f"\nSELECT a.ord, a.title, a.link, a.source FROM ({O.page_articles_sql()}) a JOIN kept USING (ord)")
def q_dedup_pages(spark, sf):
    return dedup.dedup_articles(S.page_articles(spark, sf)).select("ord", "title", "link", "source")


def _merge_src_sql() -> str:
    return (f"SELECT CASE WHEN ord % 2 = 0 THEN 0 ELSE 1 END AS batch_ord, * FROM ({O.page_articles_sql()})")


@register("merge_dedup",
          _kept_sql(_merge_src_sql(), "batch_ord * 1000000000000 + ord") +
          f"\nSELECT a.batch_ord, a.ord, a.link FROM ({_merge_src_sql()}) a "
          f"JOIN kept k ON k.ord = a.batch_ord * 1000000000000 + a.ord")
def q_merge_dedup(spark, sf):
    arts = S.page_articles(spark, sf)
    existing = arts.where(F.col("ord") % 2 == 0)  # two batches partition the table
    new = arts.where(F.col("ord") % 2 == 1)
    return dedup.merge_and_dedup(existing, new).select("batch_ord", "ord", "link")


def snapshot(spark, sf, cap: int = 200) -> DataFrame:
    """§3.1 without the network: D4 -> newest first (stable) -> cap; ``pos`` = rank."""
    arts = dedup.dedup_articles(S.page_articles(spark, sf))
    top = arts.orderBy(F.desc("published_at"), F.asc("ord")).limit(cap)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("published_at"), F.asc("ord")))
                          .cast("long"))


def _snapshot_sql(cap: int = 200) -> str:
    return (_kept_sql(O.page_articles_sql()) +
            f""",
snap AS (SELECT a.*, row_number() OVER (ORDER BY published_at DESC, ord) AS pos
         FROM ({O.page_articles_sql()}) a JOIN kept USING (ord) QUALIFY pos <= {cap})""")


@register("newest_first",
          _kept_sql(O.page_articles_sql()) +
          f"\nSELECT CAST(row_number() OVER (ORDER BY a.published_at DESC, a.ord) AS BIGINT) AS pos, a.ord, "
          f"{O.fmt_ts('a.published_at')} AS published_at, a.link FROM ({O.page_articles_sql()}) a JOIN kept USING (ord)")
def q_newest_first(spark, sf):
    arts = dedup.dedup_articles(S.page_articles(spark, sf))
    return ranked(arts).select("pos", "ord", ts_str("published_at").alias("published_at"), "link")


def ranked(arts: DataFrame) -> DataFrame:
    """``pos`` 1, 2, ... newest first, then by arrival; no window over all rows."""
    o = F.struct(-F.unix_micros("published_at"), F.col("ord"))
    return U.assign_dense_ids(arts.withColumn("_o", o), "_o", 0, id_col="pos").drop("_o")


@register("top_n_articles",
          _snapshot_sql() + f"\nSELECT pos, ord, {O.fmt_ts('published_at')} AS published_at, title, source FROM snap")
def q_top_n(spark, sf):
    return snapshot(spark, sf).select("pos", "ord", ts_str("published_at").alias("published_at"), "title", "source")


FILTER_SOURCE = "BLOG.TIONSH.EXAMPLE.NET"


@register("filter_source",
          _snapshot_sql() + f"\nSELECT pos, ord, source FROM snap WHERE lower(source) = lower({O.q(FILTER_SOURCE)})")
def q_filter_source(spark, sf):
    return (snapshot(spark, sf).where(F.lower("source") == F.lower(F.lit(FILTER_SOURCE)))
            .select("pos", "ord", "source"))


@register("paginate",
          _snapshot_sql() + "\nSELECT pos, ord, link FROM snap WHERE pos > 10 AND pos <= 30")
def q_paginate(spark, sf):
    snap = snapshot(spark, sf)
    return snap.orderBy("pos").offset(10).limit(20).select("pos", "ord", "link")


# ------------------------------------------------------------------------- content ----

@register("og_image", f"SELECT page_id, {O.og_image('html')} AS image FROM ({O.page_fixture_sql()})")
def q_og_image(spark, sf):
    return S.page_fixture(spark, sf).select("page_id", H.og_image("html").alias("image"))


@register("html_image", f"SELECT page_id, {O.html_image('html')} AS image FROM ({O.page_fixture_sql()})")
def q_html_image(spark, sf):
    return S.page_fixture(spark, sf).select("page_id", H.html_image("html").alias("image"))


@register("page_content", f"SELECT page_id, {O.main_text('html')} AS content FROM ({O.page_fixture_sql()})")
def q_page_content(spark, sf):
    return H.with_main_text(S.page_fixture(spark, sf), "html", "content").select("page_id", "content")


@register("page_main_blocks", BL.main_blocks_sql(O.page_fixture_sql()))
def q_page_main_blocks(spark, sf):
    """T2 by blocks: density rules, and what a host's pages repeat left out."""
    return BL.main_blocks(S.page_fixture(spark, sf)).select("page_id", "content")


@register("banner_strip",
          f"SELECT page_id, {O.banner_strip('mt')} AS content FROM "
          f"(SELECT page_id, {O.main_text('html')} AS mt FROM ({O.page_fixture_sql()}))")
def q_banner_strip(spark, sf):
    p = H.with_main_text(S.page_fixture(spark, sf), "html", "main")
    return H.with_banner_strip(p, "main", "content").select("page_id", "content")


def _content_attach_sql() -> str:
    ex = (f"SELECT url AS x_url, {O.og_image('html')} AS og, {O.banner_strip('mt')} AS x_content FROM "
          f"(SELECT url, html, {O.main_text('html')} AS mt FROM ({O.page_fixture_sql()}))")
    arts = (f"SELECT ord, link, CASE WHEN ord % 3 = 0 THEN 'https://feed.example/i' || ord || '.jpg' "
            f"WHEN ord % 3 = 1 THEN '' END AS image, content_extracted FROM ({O.page_articles_sql()})")
    return (f"SELECT a.ord, coalesce(nullif(a.image, ''), e.og) AS image, e.x_content AS content, "
            f"true AS content_extracted FROM ({arts}) a LEFT JOIN ({ex}) e ON a.link = e.x_url")


@register("content_attach", _content_attach_sql())
def q_content_attach(spark, sf):
    arts = S.page_articles(spark, sf)
    arts = arts.withColumn("image", F.when(F.col("ord") % 3 == 0, F.concat(
        F.lit("https://feed.example/i"), F.col("ord").cast("string"), F.lit(".jpg")))
        .when(F.col("ord") % 3 == 1, F.lit("")))
    # every third page landed before, with other content: the newest landing counts
    pages = S.page_fixture(spark, sf).withColumn("landed", F.lit(2))
    earlier = (pages.where(F.col("page_id") % 3 == 0).withColumn("landed", F.lit(1))
               .withColumn("html", F.lit("<article><p>an older landing of this page</p></article>")))
    ex = content.extract_pages(pages.unionByName(earlier), landed_col="landed")
    return content.attach_content(arts, ex).select("ord", "image", "content", "content_extracted")


def _text_fallback_sql() -> str:
    return (f"SELECT ord, coalesce(nullif(c, ''), nullif(d, ''), title) AS text FROM ("
            f"SELECT ord, title, CASE WHEN ord % 3 = 0 THEN description WHEN ord % 3 = 1 THEN '' END AS c, "
            f"CASE WHEN ord % 4 = 0 THEN '' ELSE description END AS d FROM ({O.page_articles_sql()}))")


@register("text_fallback", _text_fallback_sql())
def q_text_fallback(spark, sf):
    a = S.page_articles(spark, sf)
    c = F.when(F.col("ord") % 3 == 0, F.col("description")).when(F.col("ord") % 3 == 1, F.lit(""))
    d = F.when(F.col("ord") % 4 == 0, F.lit("")).otherwise(F.col("description"))
    return a.select("ord", X.text_fallback(c, d, "title").alias("text"))


# ------------------------------------------------------------------------ mentions ----

def _doc_texts(spark, sf):
    return S.doc_mention_texts(spark, sf)


@register("sentences",
          f"SELECT conv_id, turn, CAST(k - 1 AS BIGINT) AS pos, ss[k] AS sentence FROM ("
          f"SELECT conv_id, turn, ss, unnest(range(1, len(ss) + 1)) AS k FROM ("
          f"SELECT conv_id, turn, {O.sentences_list('text')} AS ss FROM conversations))")
def q_sentences(spark, sf):
    c = S.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.posexplode(mentions.sentences("text")).alias("pos", "sentence")) \
        .withColumn("pos", F.col("pos").cast("long"))


_MENT_COLS = "article_id, company_name, ticker, matched_text, start_char, end_char, confidence, context_sentence"


@register("mention_extract", f"WITH {O.mentions_sql(O.doc_mention_texts_sql())}\nSELECT {_MENT_COLS} FROM ments")
def q_mention_extract(spark, sf):
    return mentions.regex_mentions(_doc_texts(spark, sf))


@register("context_sentence",
          f"WITH {O.mentions_sql(O.doc_mention_texts_sql())}\n"
          "SELECT article_id, start_char, context_sentence FROM ments")
def q_context_sentence(spark, sf):
    return mentions.regex_mentions(_doc_texts(spark, sf)).select("article_id", "start_char", "context_sentence")


@register("context_compat",
          f"WITH {O.mentions_sql(O.doc_mention_texts_sql(), compat=True)}\n"
          "SELECT article_id, start_char, context_sentence FROM ments")
def q_context_compat(spark, sf):
    return (mentions.regex_mentions(_doc_texts(spark, sf), compat=True)
            .select("article_id", "start_char", "context_sentence"))


@register("mention_dedup",
          f"WITH {O.mentions_sql(O.doc_mention_texts_sql())},\n{O.mention_dedup_sql()}\n"
          "SELECT article_id, ticker, context_sentence, confidence, start_char, key_pos FROM uniq")
def q_mention_dedup(spark, sf):
    m = mentions.regex_mentions(_doc_texts(spark, sf))
    return dedup.dedup_mentions(m).select("article_id", "ticker", "context_sentence", "confidence",
                                          "start_char", "key_pos")


def _analysis_sql(src: str) -> str:
    return (f"WITH {O.mentions_sql(src)},\n{O.mention_dedup_sql()},\n"
            f"sc AS (SELECT *, {O.lexicon_probs('context_sentence')} FROM uniq)\n"
            f"SELECT article_id, company_name, ticker, matched_text, start_char, confidence AS confidence_score, "
            f"context_sentence, key_pos, round(positive - negative, 9) AS sentiment_score, "
            f"{O.label_sql()} AS sentiment_label, round(positive, 9) AS positive_prob, "
            f"round(negative, 9) AS negative_prob, round(neutral, 9) AS neutral_prob FROM sc")


def _analysis_cols(df):
    return df.select("article_id", "company_name", "ticker", "matched_text", "start_char", "confidence_score",
                     "context_sentence", "key_pos", r9("sentiment_score").alias("sentiment_score"),
                     "sentiment_label", r9("positive_prob").alias("positive_prob"),
                     r9("negative_prob").alias("negative_prob"), r9("neutral_prob").alias("neutral_prob"))


@register("company_mentions",
          _analysis_sql(f"SELECT * FROM ({O.doc_mention_texts_sql()}) WHERE length({O.strip('text')}) >= 10"))
def q_company_mentions(spark, sf):
    return _analysis_cols(mentions.analyze_text(_doc_texts(spark, sf)))


@register("article_mentions",
          _analysis_sql(f"SELECT article_id, CASE WHEN title IS NOT NULL AND title <> '' "
                        f"THEN title || chr(10) || chr(10) || text ELSE text END AS text "
                        f"FROM ({O.doc_mention_texts_sql()}) WHERE text IS NOT NULL AND text <> ''"))
def q_article_mentions(spark, sf):
    d = _doc_texts(spark, sf).withColumnRenamed("text", "content")
    return _analysis_cols(mentions.analyze_articles(d))


# ------------------------------------------------------------------------- scoring ----

@register("sentiment_score",
          f"SELECT doc_id, round(negative, 9) AS negative, round(neutral, 9) AS neutral, "
          f"round(positive, 9) AS positive FROM (SELECT doc_id, {O.lexicon_probs('text')} FROM documents)")
def q_sentiment_score(spark, sf):
    d = scoring.sentiment(S.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", r9("negative").alias("negative"), r9("neutral").alias("neutral"),
                    r9("positive").alias("positive"))


@register("sentiment_label",
          f"SELECT doc_id, round(positive - negative, 9) AS compound, {O.label_sql()} AS label FROM "
          f"(SELECT doc_id, {O.lexicon_probs('text')} "
          f"FROM ({O.doc_mention_texts_sql().replace('doc_id AS article_id', 'doc_id')}))")
def q_sentiment_label(spark, sf):
    d = S.doc_mention_texts(spark, sf).withColumnRenamed("article_id", "doc_id")
    d = scoring.sentiment(d, "text")
    return d.select("doc_id", r9("compound").alias("compound"), "label")


@register("financial_score",
          f"SELECT conv_id, turn, {O.label_sql()} AS sentiment_label, round({O.winning_sql()}, 9) AS score, "
          f"round(positive, 9) AS positive_prob, round(negative, 9) AS negative_prob, "
          f"round(neutral, 9) AS neutral_prob, round(positive - negative, 9) AS sentiment_score "
          f"FROM (SELECT conv_id, turn, {O.lexicon_probs('text')} FROM conversations)")
def q_financial_score(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    f = scoring.financial_sentiment(c, "text")
    return f.select("conv_id", "turn", "sentiment_label", r9("score").alias("score"),
                    r9("positive_prob").alias("positive_prob"), r9("negative_prob").alias("negative_prob"),
                    r9("neutral_prob").alias("neutral_prob"), r9("sentiment_score").alias("sentiment_score"))


# ---------------------------------------------------------------------- mention fold --

def _fold_sql() -> str:
    return f"""WITH m AS ({O.event_mentions_sql()}),
r AS (SELECT *, max(confidence_score) OVER (PARTITION BY article_id, company_id ORDER BY ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM m),
rec AS (SELECT * FROM r WHERE prev_max IS NULL OR confidence_score > prev_max)
SELECT article_id, company_id,
  round(list_reduce(list(sentiment_score ORDER BY ord), lambda a, b: (a + b) / 2), 9) AS sentiment_score,
  round(arg_max(confidence_score, ord), 9) AS confidence_score, arg_max(context_sentence, ord) AS context_sentence,
  max(ord) AS ord, CAST(count(*) - 1 AS BIGINT) AS replacements
FROM rec GROUP BY article_id, company_id"""


@register("mention_fold", _fold_sql())
def q_mention_fold(spark, sf):
    f = dedup.fold_mentions(S.event_mentions(spark, sf))
    return f.select("article_id", "company_id", r9("sentiment_score").alias("sentiment_score"),
                    r9("confidence_score").alias("confidence_score"), "context_sentence", "ord",
                    "replacements")


# ------------------------------------------------------------------- stores / upserts --
from ..operators import metrics as M  # noqa: E402
from ..operators import upsert as U  # noqa: E402
from ..session import DEFAULT_AS_OF, ts_lit  # noqa: E402
from ..sources import stores as ST  # noqa: E402

AS_OF_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def _sources_cte() -> str:
    return f"""pa AS ({O.page_articles_sql()}),
src_f AS (SELECT {O.url_domain('link')} AS domain, arg_min(source, ord) AS name, min(ord) AS first
          FROM pa GROUP BY 1),
src AS (SELECT CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS id, name, domain,
               CAST(0.5 AS DOUBLE) AS reliability_score, CAST(NULL AS VARCHAR) AS logo_url FROM src_f)"""


def _store_cte(content_mod: int = 3) -> str:
    return _sources_cte() + f""",
rows AS (SELECT pa.ord, title, link AS url, description AS summary, image AS image_url, published_at,
                category, CASE WHEN pa.ord % {content_mod} <> 0 THEN description END AS full_content,
                s.id AS source_id
         FROM pa LEFT JOIN src s ON s.domain = {O.url_domain('pa.link')}),
lastrow AS (SELECT url, arg_max({{'title': title, 'summary': summary, 'image_url': image_url,
                   'published_at': published_at, 'category': category, 'source_id': source_id}}, ord) AS r,
                   arg_max(full_content, ord) FILTER (WHERE full_content IS NOT NULL) AS full_content,
                   min(ord) AS first FROM rows GROUP BY url),
store AS (SELECT CAST(row_number() OVER (ORDER BY first) AS BIGINT) AS id, r.title AS title, url,
                 r.summary AS summary, r.image_url AS image_url, r.published_at AS published_at,
                 r.category AS category, full_content, r.source_id AS source_id,
                 CAST(NULL AS DOUBLE) AS overall_sentiment FROM lastrow)"""


@register("upsert_sources", f"WITH {_sources_cte()}\nSELECT * FROM src")
def q_upsert_sources(spark, sf):
    return ST.sources_store(spark, sf)


@register("upsert_articles",
          f"WITH {_store_cte()}\nSELECT id, title, url, summary, {O.fmt_ts('published_at')} AS published_at, "
          "full_content, source_id FROM store")
def q_upsert_articles(spark, sf):
    return ST.articles_store(spark, sf).select("id", "title", "url", "summary",
                                               ts_str("published_at").alias("published_at"),
                                               "full_content", "source_id")


@register("article_source_join",
          f"WITH {_sources_cte()}\nSELECT pa.ord, s.id AS source_id FROM pa LEFT JOIN src s "
          f"ON s.domain = {O.url_domain('pa.link')}")
def q_article_source_join(spark, sf):
    src = ST.sources_store(spark, sf).select("domain", F.col("id").alias("source_id"))
    a = S.page_articles(spark, sf).select("ord", X.url_domain("link").alias("domain"))
    return a.join(src, "domain", "left").select("ord", "source_id")


@register("preserve_content",
          f"WITH {_store_cte()},\nb2 AS (SELECT link AS url, arg_max(CASE WHEN ord % 2 = 0 THEN description END, ord) "
          "FILTER (WHERE ord % 2 = 0 AND description IS NOT NULL) AS c2 FROM pa GROUP BY link)\n"
          "SELECT s.id, s.url, coalesce(b2.c2, s.full_content) AS full_content FROM store s JOIN b2 USING (url)")
def q_preserve_content(spark, sf):
    store = ST.articles_store(spark, sf)
    b2 = S.page_articles(spark, sf).withColumn("content", F.when(F.col("ord") % 2 == 0, F.col("description")))
    out = U.upsert_articles(store, ST.sources_store(spark, sf), b2)
    return out.select("id", "url", "full_content")


@register("urls_with_content", f"WITH {_store_cte()}\nSELECT url FROM store WHERE full_content IS NOT NULL")
def q_urls_with_content(spark, sf):
    return ST.articles_store(spark, sf).where(F.col("full_content").isNotNull()).select("url")


@register("dim_sources_by_name",
          f"WITH {_sources_cte()}\nSELECT CAST(row_number() OVER (ORDER BY name, id) AS BIGINT) AS pos, id, name, "
          "domain FROM src")
def q_dim_sources_by_name(spark, sf):
    src = ST.sources_store(spark, sf).withColumn("_o", F.struct("name", "id"))
    # rank by (name, id) without a single-partition window: range partitions + offsets
    out = U.assign_dense_ids(src, "_o", 0, id_col="pos")
    return out.select("pos", "id", "name", "domain")


ARTICLE_SOURCE = "blog.tionsh.example.net"


@register("articles_with_source",
          f"WITH {_store_cte()}\nSELECT a.id, a.url, s.name AS source_name, s.domain, "
          f"{O.fmt_ts('a.published_at')} AS published_at FROM store a JOIN src s ON a.source_id = s.id "
          f"WHERE s.name = {O.q(ARTICLE_SOURCE)} ORDER BY a.published_at DESC, a.id LIMIT 50")
def q_articles_with_source(spark, sf):
    from ..operators import reads
    return reads.articles_with_source(ST.articles_store(spark, sf), ST.sources_store(spark, sf),
                                      ARTICLE_SOURCE, 50)


def _sent_cte() -> str:
    t = "coalesce(nullif(full_content, ''), nullif(summary, ''), title)"
    return f"sc AS (SELECT url, id AS ord, {O.lexicon_probs(t)} FROM store)"


@register("update_sentiment",
          f"WITH {_store_cte()},\n{_sent_cte()}\nSELECT s.id, s.url, round(coalesce(sc.positive - sc.negative, "
          "s.overall_sentiment), 9) AS overall_sentiment FROM store s LEFT JOIN sc USING (url)")
def q_update_sentiment(spark, sf):
    store = ST.articles_store(spark, sf)
    texts = store.select("url", F.col("id").alias("ord"),
                         X.text_fallback("full_content", "summary", "title").alias("text"))
    scores = scoring.sentiment(texts, "text")
    out = U.update_sentiment(store, scores)
    return out.select("id", "url", r9("overall_sentiment").alias("overall_sentiment"))


@register("retention",
          f"WITH {_store_cte()}\nSELECT CAST(count(*) FILTER (WHERE published_at < {AS_OF_SQL} - INTERVAL 30 DAY) "
          "AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE NOT (published_at < "
          f"{AS_OF_SQL} - INTERVAL 30 DAY) OR published_at IS NULL) AS BIGINT) AS kept FROM store")
def q_retention(spark, sf):
    from ..operators import reads
    return reads.retention_counts(ST.articles_store(spark, sf), 30, DEFAULT_AS_OF)


# ------------------------------------------------------------------------- mentions/metrics

def _mstore_cte() -> str:
    return f"""em AS ({O.event_mentions_sql()}),
r AS (SELECT *, max(confidence_score) OVER (PARTITION BY article_id, company_id ORDER BY ord
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM em),
rec AS (SELECT * FROM r WHERE prev_max IS NULL OR confidence_score > prev_max),
ms AS (SELECT article_id, company_id,
          list_reduce(list(sentiment_score ORDER BY ord), lambda a, b: (a + b) / 2) AS sentiment_score,
          arg_max(confidence_score, ord) AS confidence_score, arg_max(context_sentence, ord) AS context_sentence,
          arg_max(created_at, ord) AS created_at FROM rec GROUP BY article_id, company_id)"""


@register("upsert_mentions",
          f"WITH {_mstore_cte()},\nold AS (SELECT article_id, company_id, min(created_at) - INTERVAL 40 DAY AS created_at "
          "FROM em WHERE article_id % 3 = 0 GROUP BY 1, 2)\n"
          "SELECT article_id, company_id, round(sentiment_score, 9) AS sentiment_score, confidence_score, context_sentence, "
          f"{O.fmt_ts('created_at')} AS created_at FROM (SELECT ms.* REPLACE (coalesce(old.created_at, ms.created_at) AS created_at) "
          "FROM ms LEFT JOIN old USING (article_id, company_id) UNION ALL SELECT -1 - article_id, company_id, "
          "0.25::DOUBLE, 0.5::DOUBLE, 'stored', created_at FROM old)")
def q_upsert_mentions(spark, sf):
    """The store holds mentions of a third of the articles, 40 days older, and some of
    articles that the batch doesn't touch."""
    em = S.event_mentions(spark, sf)
    old = (em.where(F.col("article_id") % 3 == 0).groupBy("article_id", "company_id")
           .agg((F.min("created_at") - F.expr("INTERVAL 40 DAYS")).alias("created_at"))
           .select("article_id", "company_id", F.lit(0.25).alias("sentiment_score"), F.lit(0.5).alias("confidence_score"),
                   F.lit("stored").alias("context_sentence"), "created_at"))
    store = old.unionByName(old.withColumn("article_id", -1 - F.col("article_id")))
    m = U.upsert_mentions(store, em)
    return m.select("article_id", "company_id", r9("sentiment_score").alias("sentiment_score"),
                    "confidence_score", "context_sentence", ts_str("created_at").alias("created_at"))


def _daily_sql(compat: bool) -> str:
    cond = "WHERE CAST(created_at AS TIME) < TIME '23:59:59'" if compat else ""
    return (f"WITH em AS ({O.event_mentions_sql()})\nSELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, "
            f"company_id, round(avg(sentiment_score), 9) AS avg_sentiment, CAST(count(*) AS BIGINT) AS article_volume "
            f"FROM em {cond} GROUP BY 1, 2")


def _daily(spark, sf, compat):
    d = M.daily_metrics(S.event_mentions(spark, sf), compat)
    return d.select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


@register("daily_metrics", _daily_sql(False))
def q_daily_metrics(spark, sf):
    return _daily(spark, sf, False)


@register("daily_metrics_compat", _daily_sql(True))
def q_daily_metrics_compat(spark, sf):
    return _daily(spark, sf, True)


@register("company_metrics",
          f"WITH d AS ({_daily_sql(False)}), c AS ({O.companies_sql()})\n"
          "SELECT d.date, d.company_id, c.name, c.ticker, d.avg_sentiment, d.article_volume FROM d "
          "JOIN c ON c.id = d.company_id WHERE c.ticker = 'NVDA' AND d.date >= '2024-01-25'")
def q_company_metrics(spark, sf):
    d = _daily(spark, sf, False)
    out = M.company_metric_series(d, ST.companies(spark), "NVDA", 7, DEFAULT_AS_OF)
    return out.select("date", "company_id", "name", "ticker", "avg_sentiment", "article_volume")


@register("recent_mentions",
          f"WITH {_mstore_cte()}\nSELECT article_id, company_id, {O.fmt_ts('created_at')} AS created_at FROM ms "
          f"WHERE created_at >= {AS_OF_SQL} - INTERVAL 7 DAY ORDER BY created_at DESC, article_id, company_id LIMIT 50")
def q_recent_mentions(spark, sf):
    from ..operators import reads
    m = reads.recent_mentions(ST.mentions_store(spark, sf), DEFAULT_AS_OF, days=7, limit=50)
    return m.select("article_id", "company_id", ts_str("created_at").alias("created_at"))


@register("mention_company_join",
          f"WITH {O.mentions_sql(O.doc_mention_texts_sql())}, c AS ({O.companies_sql()})\n"
          "SELECT ments.article_id, ments.start_char, c.id AS company_id FROM ments JOIN c USING (ticker)")
def q_mention_company_join(spark, sf):
    from ..operators import reads
    m = mentions.regex_mentions(_doc_texts(spark, sf))
    return reads.mention_company_ids(m, ST.companies(spark)).select("article_id", "start_char", "company_id")


@register("mentions_enriched",
          f"WITH {_mstore_cte()}, c AS ({O.companies_sql()}), "
          f"d AS ({O.doc_articles_sql()})\nSELECT ms.article_id, ms.company_id, d.title AS article_title, "
          "c.name AS company_name, c.ticker FROM ms LEFT JOIN d ON d.ord = ms.article_id "
          "LEFT JOIN c ON c.id = ms.company_id WHERE c.ticker = 'TSLA'")
def q_mentions_enriched(spark, sf):
    from ..operators import reads
    arts = S.doc_articles(spark, sf).select(F.col("ord").alias("id"), "title", F.col("link").alias("url"),
                                            "published_at")
    out = reads.mentions_enriched(ST.mentions_store(spark, sf), arts, ST.companies(spark), ticker="TSLA")
    return out.select("article_id", "company_id", "article_title", "company_name", "ticker")


def _analysis_cte() -> str:
    return (f"{O.mentions_sql(O.doc_mention_texts_sql())},\n{O.mention_dedup_sql()},\n"
            f"sc AS (SELECT *, {O.lexicon_probs('context_sentence')} FROM uniq),\n"
            f"an AS (SELECT *, positive - negative AS sentiment_score, {O.label_sql()} AS sentiment_label FROM sc)")


@register("company_summary",
          f"WITH {_analysis_cte()}\nSELECT ticker, arg_min(company_name, (article_id, key_pos)) AS company_name, "
          "CAST(count(*) AS BIGINT) AS mention_count, round(sum(sentiment_score), 9) AS total_sentiment, "
          "round(avg(sentiment_score), 9) AS avg_sentiment, "
          "CAST(count(*) FILTER (WHERE sentiment_label = 'positive') AS BIGINT) AS positive_count, "
          "CAST(count(*) FILTER (WHERE sentiment_label = 'negative') AS BIGINT) AS negative_count, "
          "CAST(count(*) FILTER (WHERE sentiment_label NOT IN ('positive', 'negative')) AS BIGINT) AS neutral_count, "
          "array_to_string(list(left(context_sentence, 200) ORDER BY article_id, key_pos)[1:5], '|') AS contexts "
          "FROM an GROUP BY ticker")
def q_company_summary(spark, sf):
    a = mentions.analyze_text(_doc_texts(spark, sf))
    s = M.company_summary(a)
    return s.select("ticker", "company_name", "mention_count", r9("total_sentiment").alias("total_sentiment"),
                    r9("avg_sentiment").alias("avg_sentiment"), "positive_count", "negative_count",
                    "neutral_count", "contexts")


@register("article_company_counts",
          f"WITH {_analysis_cte()}\nSELECT article_id, CAST(count(DISTINCT ticker) AS BIGINT) AS companies_found, "
          "CAST(count(*) AS BIGINT) AS total_mentions FROM an GROUP BY article_id")
def q_article_company_counts(spark, sf):
    return M.article_company_counts(mentions.analyze_text(_doc_texts(spark, sf)))


@register("avg_sentiment",
          f"SELECT round(coalesce(avg(negative), 0.0), 9) AS negative, round(coalesce(avg(neutral), 1.0), 9) AS neutral, "
          f"round(coalesce(avg(positive), 0.0), 9) AS positive, round(coalesce(avg(positive - negative), 0.0), 9) "
          f"AS compound, CASE WHEN coalesce(avg(positive - negative), 0) >= 0.05 THEN 'positive' "
          f"WHEN coalesce(avg(positive - negative), 0) <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, "
          f"CAST(count(*) AS BIGINT) AS texts FROM (SELECT {O.lexicon_probs('text')} FROM conversations)")
def q_avg_sentiment(spark, sf):
    c = scoring.sentiment(S.table(spark, sf, "conversations").select("text"), "text")
    a = M.average_sentiment(c)
    return a.select(*[r9(x).alias(x) for x in ("negative", "neutral", "positive", "compound")], "label", "texts")


@register("sentiment_by_source",
          f"WITH a AS ({O.doc_articles_sql()}), top AS (SELECT * FROM a QUALIFY row_number() OVER "
          "(PARTITION BY source ORDER BY published_at DESC, ord) <= 20), "
          f"sc AS (SELECT source, {O.lexicon_probs("coalesce(nullif(content, ''), nullif(description, ''), title)")} FROM top)\n"
          "SELECT source, CAST(count(*) AS BIGINT) AS articles_analyzed, round(avg(positive - negative), 4) AS "
          "average_compound, CASE WHEN avg(positive - negative) >= 0.05 THEN 'positive' WHEN avg(positive - negative) "
          "<= -0.05 THEN 'negative' ELSE 'neutral' END AS overall_label FROM sc GROUP BY source")
def q_sentiment_by_source(spark, sf):
    top = M.newest_per_group(S.doc_articles(spark, sf), "source", 20)
    t = top.select("source", X.text_fallback("content", "description", "title").alias("text"))
    return M.sentiment_report(scoring.sentiment(t, "text"))


# -------------------------------------------------------------------- normalization ----
from ..operators import normalize as NZ  # noqa: E402
from ..sources import dims as D  # noqa: E402
from ..sources import feeds as FD  # noqa: E402


def _feed_articles(spark, sf):
    return NZ.normalize_entries(FD.raw_items_from_pages(spark, sf), D.feed_sources(spark), DEFAULT_AS_OF)


def _arts_sql(select: str) -> str:
    return f"WITH {O.normalized_sql()}\nSELECT {select} FROM arts"


@register("feed_scan_cap",
          f"WITH raw AS ({O.raw_items_sql()})\nSELECT feed_ord, entry_ord FROM raw "
          "QUALIFY row_number() OVER (PARTITION BY feed_ord ORDER BY entry_ord) <= 50")
def q_feed_scan_cap(spark, sf):
    return NZ.cap_per_feed(FD.raw_items_from_pages(spark, sf)).select("feed_ord", "entry_ord")


_TERM_SQL = O.strip("coalesce(t.term, '')")


@register("tag_exclude",
          f"WITH raw AS ({O.raw_items_sql()})\nSELECT feed_ord, entry_ord, coalesce(list_bool_or(list_transform("
          f"tags, lambda t: lower({_TERM_SQL}) = 'top bm')), false) AS excluded FROM raw")
def q_tag_exclude(spark, sf):
    r = FD.raw_items_from_pages(spark, sf)
    return r.select("feed_ord", "entry_ord", NZ.excluded_by_tag("tags").alias("excluded"))


@register("entry_required", _arts_sql("ord, title, link, source"))
def q_entry_required(spark, sf):
    return _feed_articles(spark, sf).select("ord", "title", "link", "source")


@register("category_infer", _arts_sql("ord, category"))
def q_category_infer(spark, sf):
    return _feed_articles(spark, sf).select("ord", "category")


@register("date_parse", _arts_sql(f"ord, {O.fmt_ts('published_at')} AS published_at"))
def q_date_parse(spark, sf):
    return _feed_articles(spark, sf).select("ord", ts_str("published_at").alias("published_at"))


@register("entry_description", _arts_sql("ord, description"))
def q_entry_description(spark, sf):
    return _feed_articles(spark, sf).select("ord", "description")


@register("feed_full_content", _arts_sql("ord, content, content_extracted"))
def q_feed_full_content(spark, sf):
    return _feed_articles(spark, sf).select("ord", "content", "content_extracted")


@register("entry_image", _arts_sql("ord, image"))
def q_entry_image(spark, sf):
    return _feed_articles(spark, sf).select("ord", "image")


SITEMAP_SOURCE = ("Reuters", "https://www.reuters.com/arc/outboundfeeds/news-sitemap/?outputType=xml",
                  "news", False, True)


def _sitemap_sql() -> str:
    title = O.strip("coalesce(title, '')")
    ts = "(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 HOUR)"
    items = (f"SELECT 10 AS feed_ord, page_id AS entry_ord, CASE WHEN page_id % 3 = 0 THEN "
             r"regexp_replace(url, '(://[^/]+)/[a-z]{2}/', '\1/news/') ELSE url END AS loc, CASE WHEN page_id % 9 = 0 THEN ' ' ELSE "
             r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS title, "
             f"CASE WHEN page_id % 4 <> 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') END AS publication_date, "
             "CASE WHEN page_id % 3 = 0 THEN 'https://img.example/s' || page_id || '.jpg' END AS image_loc FROM pages")
    seg = f"split_part(regexp_replace({O.url_path('loc')}, '\\A/+|/+\\z', '', 'g'), '/', 1)"
    pub = "CASE WHEN entry_ord % 4 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + entry_ord * INTERVAL 1 HOUR END"
    return f"""WITH it AS ({items}), srcs AS ({O.feed_sources_sql([SITEMAP_SOURCE])})
SELECT CAST(c.feed_ord AS BIGINT) * 1000000000 + entry_ord AS ord, {title} AS title, loc AS link,
  s.name AS source, {O.fmt_ts(f'coalesce({pub}, {AS_OF_SQL})')} AS published_at, image_loc AS image,
  s.category AS category
FROM it c JOIN srcs s USING (feed_ord)
WHERE loc IS NOT NULL AND loc <> '' AND NOT regexp_matches({seg}, '\\A\\p{{L}}{{2}}\\z') AND {title} <> ''"""


@register("url_lang_prefix", _sitemap_sql())
def q_url_lang_prefix(spark, sf):
    srcs = D.add_feed_source(D.feed_sources(spark), *SITEMAP_SOURCE)
    out = NZ.normalize_sitemap(FD.sitemap_items_from_pages(spark, sf), srcs, DEFAULT_AS_OF)
    return out.select("ord", "title", "link", "source", ts_str("published_at").alias("published_at"), "image",
                      "category")


@register("resolve_redirects",
          f"WITH a AS (SELECT ord, source, CASE WHEN ord % 2 = 0 THEN 'https://news.google.com/rss/' || link ELSE link END "
          f"AS link FROM ({O.page_articles_sql()}))\n"
          "SELECT ord, CASE WHEN ord % 2 = 0 AND ord % 5 <> 4 AND ord % 7 <> 0 THEN "
          "'https://decoded.example/' || md5(link) ELSE link END AS link FROM a")
def q_resolve_redirects(spark, sf):
    """Links of one host; the feeds of ord % 7 = 0 aren't that host's; ord % 5 = 4 weren't
    decoded; other hosts' links have decodings that must not be used, and so have second ones."""
    link = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("https://news.google.com/rss/"), "link")).otherwise(F.col("link"))
    a = (S.page_articles(spark, sf).withColumn("link", link)
         .withColumn("source", F.when(F.col("ord") % 7 == 0, F.lit("Other")).otherwise(F.lit("Aggregator"))))
    rmap = a.where(F.col("ord") % 5 != 4).select("ord", "link", F.concat(
        F.lit("https://decoded.example/"), F.md5(F.col("link").cast("binary"))).alias("decoded_url"))
    later = rmap.select((F.col("ord") + 1_000_000_000).alias("ord"), "link", F.lit("https://a-later.example/").alias("decoded_url"))
    srcs = D.add_feed_source(D.add_feed_source(D.feed_sources(spark), "Aggregator", "https://news.google.com/rss/x", "news"),
                             "Other", "https://other.example/rss", "news")
    return NZ.resolve_redirects(a, rmap.unionByName(later), srcs).select("ord", "link")


def _feed_status_sql() -> str:
    return (f"WITH {O.normalized_sql()},\ngot AS (SELECT feed_ord, count(*) AS n FROM raw GROUP BY 1),\n"
            "made AS (SELECT CAST(ord // 1000000000 AS INTEGER) AS feed_ord, count(*) AS n FROM arts GROUP BY 1)\n"
            "SELECT s.feed_ord, s.name, CAST(coalesce(made.n, 0) AS BIGINT) AS articles, CASE WHEN got.n IS NULL "
            "THEN 'Failed to parse feed: ' || s.name END AS error FROM srcs s LEFT JOIN got USING (feed_ord) "
            "LEFT JOIN made USING (feed_ord)")


@register("feed_status", _feed_status_sql())
def q_feed_status(spark, sf):
    raw = FD.raw_items_from_pages(spark, sf)
    srcs = D.feed_sources(spark)
    return NZ.feed_status(raw, NZ.normalize_entries(raw, srcs, DEFAULT_AS_OF), srcs)


@register("run_result",
          f"WITH st AS ({_feed_status_sql()})\nSELECT CAST(sum(articles) AS BIGINT) AS total_count, "
          "CAST(count(*) AS BIGINT) AS sources_fetched, CAST(count(error) AS BIGINT) AS sources_failed, "
          "string_agg(error, chr(10) ORDER BY feed_ord) AS errors, count(error) < count(*) AS success FROM st")
def q_run_result(spark, sf):
    st = q_feed_status(spark, sf)
    return M.run_result(st).select("total_count", "sources_fetched", "sources_failed", "errors", "success")


def _aggregate_flow_sql() -> str:
    sm = _sitemap_sql()
    both = (f"arts AS (SELECT ord, title, link, source, published_at, 1 AS k FROM feed_arts UNION ALL "
            f"SELECT ord, title, link, source, CAST(published_at AS TIMESTAMP), 2 FROM ({sm}))")
    head = f"WITH {O.normalized_sql().replace('arts AS (SELECT CAST(feed_ord', 'feed_arts AS (SELECT CAST(feed_ord')},\n{both}"
    kept = O.greedy_keep_sql(O.dedup_keys_sql("SELECT * FROM arts", "ord"))
    kept = kept.replace("WITH RECURSIVE", "", 1) if kept.lstrip().startswith("WITH RECURSIVE") else kept.replace("WITH", "", 1)
    return (head.replace("WITH", "WITH RECURSIVE", 1) + "," + kept +
            f"\nSELECT CAST(row_number() OVER (ORDER BY published_at DESC, ord) AS BIGINT) AS pos, ord, title, link, source, "
            f"{O.fmt_ts('published_at')} AS published_at FROM arts JOIN kept USING (ord)")


@register("aggregate_flow", _aggregate_flow_sql())
def q_aggregate_flow(spark, sf):
    """§3.1 over all rows: feed entries and sitemap items, D4, newest first with ranks."""
    from .sync import collect_articles
    srcs = D.add_feed_source(D.feed_sources(spark), *SITEMAP_SOURCE)
    arts = collect_articles(FD.raw_items_from_pages(spark, sf), srcs, DEFAULT_AS_OF, FD.sitemap_items_from_pages(spark, sf))
    return ranked(arts).select("pos", "ord", "title", "link", "source", ts_str("published_at").alias("published_at"))


# -------------------------------------------------------------- snapshot / pending ----

def _snap_sql_cols(cols: str) -> str:
    return _snapshot_sql() + f"\nSELECT {cols} FROM snap"


@register("pending_extract", _snapshot_sql() + "\nSELECT pos, ord, link FROM snap WHERE NOT content_extracted "
          "ORDER BY pos LIMIT 10")
def q_pending_extract(spark, sf):
    return content.pending_extraction(snapshot(spark, sf), 10).select("pos", "ord", "link")


@register("needs_content",
          _snapshot_sql() + ",\n" + _store_cte() +
          "\nSELECT pos, ord, link FROM snap WHERE link NOT IN (SELECT url FROM store WHERE full_content IS NOT NULL) "
          "AND NOT content_extracted ORDER BY pos LIMIT 60")
def q_needs_content(spark, sf):
    return content.needs_content(snapshot(spark, sf), ST.articles_store(spark, sf), 60).select("pos", "ord", "link")


@register("snapshot_status",
          _snapshot_sql() + "\nSELECT CAST(count(*) AS BIGINT) AS articles_in_cache, CAST(120 AS BIGINT) AS "
          "cache_age_seconds, count(*) > 0 AND 120 <= 300 AS is_valid FROM snap")
def q_snapshot_status(spark, sf):
    from datetime import timedelta
    snap = snapshot(spark, sf).withColumn("snapshot_ts", ts_lit(DEFAULT_AS_OF - timedelta(seconds=120)))
    return M.snapshot_status(snap, DEFAULT_AS_OF).select(
        "articles_in_cache", F.col("cache_age_seconds").cast("long").alias("cache_age_seconds"), "is_valid")


def _snapshot_update_sql() -> str:
    ex = (f"SELECT url AS x_url, {O.og_image('html')} AS og, {O.banner_strip('mt')} AS x_content FROM "
          f"(SELECT url, html, {O.main_text('html')} AS mt FROM ({O.page_fixture_sql()}))")
    return (_snapshot_sql() + f",\npend AS (SELECT * FROM snap WHERE NOT content_extracted ORDER BY pos LIMIT 10),\n"
            f"upd AS (SELECT p.link, coalesce(nullif(p.image, ''), e.og) AS image, e.x_content AS content "
            f"FROM pend p LEFT JOIN ({ex}) e ON p.link = e.x_url)\n"
            "SELECT s.pos, s.ord, CASE WHEN u.link IS NOT NULL THEN true ELSE s.content_extracted END AS "
            "content_extracted, CASE WHEN u.link IS NOT NULL THEN u.image ELSE s.image END AS image, "
            "CASE WHEN u.link IS NOT NULL THEN u.content ELSE s.content END AS content "
            "FROM snap s LEFT JOIN upd u ON s.link = u.link AND s.pos = (SELECT min(pos) FROM snap s2 "
            "WHERE s2.link = u.link)")


@register("snapshot_update", _snapshot_update_sql())
def q_snapshot_update(spark, sf):
    snap = snapshot(spark, sf)
    pend = content.pending_extraction(snap, 10)
    pages = S.page_fixture(spark, sf).join(pend.select(F.col("link").alias("url")), "url", "left_semi")
    upd = content.attach_content(pend.drop("pos"), content.extract_pages(pages))
    out = U.replace_in_snapshot(snap, upd)
    return out.select("pos", "ord", "content_extracted", "image", "content")


def _metrics_upsert_sql() -> str:
    def daily(cond):
        return (f"SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, company_id, avg(sentiment_score) "
                f"AS avg_sentiment, count(*) AS article_volume FROM em WHERE {cond} GROUP BY 1, 2")
    t_sql = daily("created_at < TIMESTAMP '2024-01-20'")
    b_sql = daily("created_at >= TIMESTAMP '2024-01-15'")
    return (f"WITH em AS ({O.event_mentions_sql()}), t AS ({t_sql}), b AS ({b_sql})\n"
            "SELECT coalesce(b.date, t.date) AS date, coalesce(b.company_id, t.company_id) AS company_id, "
            "round(CASE WHEN b.date IS NOT NULL THEN b.avg_sentiment ELSE t.avg_sentiment END, 9) AS avg_sentiment, "
            "CAST(CASE WHEN b.date IS NOT NULL THEN b.article_volume ELSE t.article_volume END AS BIGINT) "
            "AS article_volume FROM t FULL OUTER JOIN b ON t.date = b.date AND t.company_id = b.company_id")


@register("upsert_generic", _metrics_upsert_sql())
def q_upsert_generic(spark, sf):
    from datetime import datetime
    em = S.event_mentions(spark, sf)
    target = M.daily_metrics(em.where(F.col("created_at") < ts_lit(datetime(2024, 1, 20))))
    batch = M.daily_metrics(em.where(F.col("created_at") >= ts_lit(datetime(2024, 1, 15))))
    out = U.upsert(target, batch, ["date", "company_id"])
    return out.select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


@register("unanalyzed_articles",
          f"WITH {_analysis_cte()},\nd AS ({O.doc_articles_sql()}),\ntop AS (SELECT ord AS id, link AS url FROM d "
          "WHERE content IS NOT NULL ORDER BY published_at DESC, ord LIMIT 50)\n"
          "SELECT id, url FROM top WHERE id NOT IN (SELECT article_id FROM an)")
def q_unanalyzed_articles(spark, sf):
    from ..operators import reads
    arts = S.doc_articles(spark, sf).select(F.col("ord").alias("id"), F.col("link").alias("url"), "title",
                                            F.col("content").alias("full_content"), "published_at")
    found = mentions.analyze_text(_doc_texts(spark, sf))
    return reads.unanalyzed_articles(arts, found, 50).select("id", "url")


# ------------------------------------------------------------------------ summaries ----
from ..operators import rankers as RK  # noqa: E402
from ..operators import summarize as SM  # noqa: E402


def _words_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({O.strip(x)}, {O.q(X.WS_RUN)}), lambda w: w <> '')"


def _truncate_sql(x: str, n: int) -> str:
    w = _words_sql(x)
    return f"CASE WHEN len({w}) <= {n} THEN {x} ELSE array_to_string({w}[1:{n}], ' ') || '...' END"


@register("summary_truncate", f"SELECT doc_id, {_truncate_sql('text', 50)} AS summary FROM documents")
def q_summary_truncate(spark, sf):
    d = S.table(spark, sf, "documents")
    return d.select("doc_id", X.truncate_words("text", 50).alias("summary"))


def _summary_record_sql() -> str:
    t = "coalesce(nullif(content, ''), nullif(description, ''), '')"
    summ = _truncate_sql("t", 200)
    return (f"SELECT ord, title AS original_title, source, CASE WHEN t = '' THEN 'No content available to summarize.' "
            f"ELSE {summ} END AS summary, 'truncate' AS summarized_by, CASE WHEN t = '' THEN 0 ELSE "
            f"CAST(len({_words_sql('t')}) AS BIGINT) END AS original_length, CASE WHEN t = '' THEN 0 ELSE "
            f"CAST(len({_words_sql(summ)}) AS BIGINT) END AS summary_length FROM (SELECT *, {t} AS t "
            f"FROM ({O.doc_articles_sql()}))")


@register("summary_record", _summary_record_sql())
def q_summary_record(spark, sf):
    return SM.summary_record(S.doc_articles(spark, sf), SM.TruncateSummarizer(), 200) \
        .select("ord", "original_title", "source", "summary", "summarized_by", "original_length", "summary_length")


def _ranked_sql(scores: str, max_length: int = 200) -> str:
    """``scores``: CTEs ending in ``sc`` (doc_id, k, score) over ``se`` and ``inc``."""
    from ..operators.scoring import TOKEN_SPLIT
    n = SM.sentence_count(max_length)
    stop = "[" + ", ".join(O.q(w) for w in RK.STOP_WORDS) + "]"
    return f"""WITH d AS (SELECT doc_id, text FROM documents),
lg AS (SELECT * FROM d WHERE length({O.strip('text')}) >= {SM.MIN_CHARS}),
sp AS (SELECT doc_id, {O.sentences_list('text')} AS ss FROM lg),
se AS (SELECT doc_id, k - 1 AS k, ss[k] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS k FROM sp)),
tk AS (SELECT doc_id, k, unnest(list_filter(regexp_split_to_array(lower(sentence), {O.q(TOKEN_SPLIT)}),
          lambda t: t <> '' AND NOT list_contains({stop}, t))) AS term FROM se),
inc AS MATERIALIZED (SELECT doc_id, k, term, count(*) AS tf FROM tk GROUP BY ALL),
{scores},
ranked AS (SELECT se.doc_id, se.k, se.sentence FROM se LEFT JOIN sc USING (doc_id, k) WHERE se.doc_id IN (SELECT doc_id FROM inc)
           QUALIFY row_number() OVER (PARTITION BY se.doc_id ORDER BY round(coalesce(sc.score, 0.0), {RK.DIGITS}) DESC, se.k) <= {n}),
summ AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY k) AS s FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR length({O.strip('d.text')}) < {SM.MIN_CHARS} THEN d.text
  WHEN coalesce(summ.s, '') = '' THEN left(d.text, 500) ELSE summ.s END AS summary
FROM d LEFT JOIN summ USING (doc_id)"""


def _luhn_sql(max_length: int = 200) -> str:
    return _ranked_sql("""fq AS (SELECT doc_id, term, sum(tf) AS f FROM inc GROUP BY ALL),
sc AS (SELECT doc_id, k, pow(coalesce(sum(tf) FILTER (WHERE f >= 2), 0), 2) / sum(tf) AS score FROM inc JOIN fq USING (doc_id, term) GROUP BY ALL)""", max_length)


def _walk_sql(nodes: str) -> str:
    """CTEs of a damped walk over ``lk`` (doc_id, i, j, w) and ``nodes`` (doc_id, k)."""
    out = ["rw AS MATERIALIZED (SELECT doc_id, i, sum(w) AS row FROM lk GROUP BY ALL)",
           f"s0 AS (SELECT doc_id, k, 1.0::DOUBLE AS score FROM ({nodes}))"]
    for r in range(RK.ROUNDS):
        out.append(f"""s{r + 1} AS MATERIALIZED (SELECT doc_id, k, {1 - RK.DAMPING}::DOUBLE + {RK.DAMPING}::DOUBLE * coalesce(f, 0.0) AS score FROM s{r} LEFT JOIN (
  SELECT lk.doc_id, j AS k, sum(w * score / row) AS f FROM lk JOIN rw ON rw.doc_id = lk.doc_id AND rw.i = lk.i
  JOIN s{r} ON s{r}.doc_id = lk.doc_id AND s{r}.k = lk.i GROUP BY ALL) USING (doc_id, k))""")
    return ",\n".join([*out, f"sc AS (SELECT * FROM s{RK.ROUNDS})"])


def _textrank_sql() -> str:
    """Every pair of sentences with a common word, written out."""
    return _ranked_sql(f"""sz AS (SELECT doc_id, k, count(*) AS a FROM inc GROUP BY ALL),
lk AS MATERIALIZED (SELECT c.doc_id, i, j, n / (ln(1.0 + x.a) + ln(1.0 + y.a)) AS w FROM (
    SELECT p.doc_id, p.k AS i, q.k AS j, count(*) AS n FROM inc p JOIN inc q ON p.doc_id = q.doc_id AND p.term = q.term AND p.k <> q.k GROUP BY ALL) c
  JOIN sz x ON x.doc_id = c.doc_id AND x.k = i JOIN sz y ON y.doc_id = c.doc_id AND y.k = j),
{_walk_sql("SELECT doc_id, k FROM sz")}""")


def _lexrank_sql() -> str:
    """The cosine of every pair of sentences with a common word, then the threshold."""
    return _ranked_sql(f"""m AS (SELECT doc_id, count(*) AS m FROM se GROUP BY ALL),
df AS (SELECT doc_id, term, count(*) AS df FROM inc GROUP BY ALL),
v AS MATERIALIZED (SELECT doc_id, k, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id, k)) AS w FROM (
    SELECT doc_id, k, term, tf * (ln(m / (1.0 + df)) + 1) AS w FROM inc JOIN df USING (doc_id, term) JOIN m USING (doc_id))),
lk AS MATERIALIZED (SELECT p.doc_id, p.k AS i, q.k AS j, 1.0::DOUBLE AS w FROM v p JOIN v q ON p.doc_id = q.doc_id AND p.term = q.term
  GROUP BY ALL HAVING round(sum(p.w * q.w), 9) >= {RK.LEXRANK_COSINE}),
{_walk_sql("SELECT doc_id, k FROM se")}""")


def _lsa_sql() -> str:
    three = (1, 2, 3)
    product = ("SELECT doc_id, k, " + ", ".join(f"sum(tf * z{c}) AS y{c}" for c in three) + " FROM inc JOIN (SELECT doc_id, term, "
               + ", ".join(f"sum(tf * q{c}) AS z{c}" for c in three) + " FROM inc JOIN {q} USING (doc_id, k) GROUP BY ALL) USING (doc_id, term) GROUP BY ALL")
    out = ["q0 AS (SELECT DISTINCT doc_id, k, " + ", ".join(f"cos((k + 1) * {c}.0) AS q{c}" for c in three) + " FROM inc)"]
    inv = f"CASE WHEN {{d}} > {RK.RANK_EPS}::DOUBLE * {{g}} THEN 1 / sqrt({{d}}) ELSE 0.0 END"
    for r in range(RK.LSA_ROUNDS):
        out.append(f"y{r} AS MATERIALIZED ({product.format(q=f'q{r}')})")
        out.append(f"g{r} AS (SELECT doc_id, " + ", ".join(f"sum(y{a} * y{b}) AS g{a}{b}" for a in three for b in three if a <= b) + f" FROM y{r} GROUP BY ALL)")
        out.append(f"a{r} AS (SELECT *, {inv.format(d='g11', g='0.0')} AS i1 FROM g{r}), b{r} AS (SELECT *, g12 * i1 AS r12, g13 * i1 AS r13 FROM a{r}), "
                   f"c{r} AS (SELECT *, {inv.format(d='(g22 - r12 * r12)', g='g22')} AS i2 FROM b{r}), e{r} AS (SELECT *, (g23 - r12 * r13) * i2 AS r23 FROM c{r}), "
                   f"f{r} AS (SELECT *, {inv.format(d='(g33 - r13 * r13 - r23 * r23)', g='g33')} AS i3 FROM e{r})")
        out.append(f"""q{r + 1} AS MATERIALIZED (SELECT doc_id, k, q1, q2, (y3 - r13 * q1 - r23 * q2) * i3 AS q3 FROM (
  SELECT *, (y2 - r12 * q1) * i2 AS q2 FROM (SELECT *, y1 * i1 AS q1 FROM y{r} JOIN f{r} USING (doc_id))))""")
    last = f"q{RK.LSA_ROUNDS}"
    out.append(f"sc AS (SELECT doc_id, k, sqrt(greatest(0.0, q1 * y1 + q2 * y2 + q3 * y3)) AS score FROM ({product.format(q=last)}) JOIN {last} USING (doc_id, k))")
    return _ranked_sql(",\n".join(out))


def _ranked_summary(algorithm: str):
    def q(spark, sf):
        d = S.table(spark, sf, "documents").select("doc_id", "text")
        return SM.RankedSummarizer(algorithm).summarize(d, "doc_id", "text", 200).select("doc_id", "summary")
    return q


for _algo, _sql in (("luhn", _luhn_sql), ("textrank", _textrank_sql), ("lexrank", _lexrank_sql), ("lsa", _lsa_sql)):
    register(f"summary_{_algo}", _sql())(_ranked_summary(_algo))


# ------------------------------------------------------------------------ streaming ----

@register("stream_daily_metrics", _daily_sql(False))
def q_stream_daily_metrics(spark, sf):
    from ..streaming.ingest import daily_metrics_via_stream
    t = daily_metrics_via_stream(spark, sf, "events.parquet", S.events_to_mentions)
    return t.select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


@register("stream_daily_metrics_late", _daily_sql(False))
def q_stream_daily_metrics_late(spark, sf):
    """R3 over two landings, one micro-batch each: the later half of the month lands first."""
    from ..streaming import ingest as ST
    e = S.table(spark, sf, "events")
    root = ST.scratch(spark, "late")
    t = ST.MergeTable(spark, f"{root}/table", ST.SUMS, ST.SUMS_KEY)
    for n, part in enumerate((F.dayofmonth("ts") >= 16, F.dayofmonth("ts") < 16)):
        e.where(part).write.parquet(f"{root}/in/{n}")
        ST.stream_daily_metrics(spark, f"{root}/in/*", e.schema, t, f"{root}/_checkpoint", to_mentions=S.events_to_mentions)
    return ST.metrics_of(t.read()).select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


@register("stream_event_time_metrics", _daily_sql(False))
def q_stream_event_time_metrics(spark, sf):
    """R3 with event-time state: three landings, newest days first, one row in ten a landing
    late; the watermark is two days behind. Open, closed and late sums make batch A4."""
    from ..streaming import ingest as ST
    from ..streaming import stateful as SF
    e = S.table(spark, sf, "events")
    root = ST.scratch(spark, "event-time")
    t = SF.daily_sums_table(spark, f"{root}/table")
    third = F.coalesce(F.floor((F.dayofmonth("ts") - 1) / 11), F.lit(0))
    turn = F.least(F.lit(2), 2 - third + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    for n in range(3):
        e.where(turn == n).write.parquet(f"{root}/in/{n}")
        m = S.events_to_mentions(spark.readStream.schema(e.schema).parquet(f"{root}/in/*"))
        SF.stream_event_time_metrics(m, t, f"{root}/_checkpoint", "2 days")
    return SF.event_time_metrics(t).select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


def _expiring_sql(hours: int) -> str:
    """From each kept row the next one of its key that is ``hours`` or more after it, in arrival order."""
    return f"""WITH RECURSIVE r AS (SELECT {O.normalize_url('link')} AS key, ord, published_at AS t,
    row_number() OVER (PARTITION BY {O.normalize_url('link')} ORDER BY ord % 2, ord) AS pos FROM ({O.doc_articles_sql()})),
k AS (SELECT key, ord, t, pos FROM r WHERE pos = 1
  UNION ALL SELECT key, ord, t, pos FROM (SELECT r.*, row_number() OVER (PARTITION BY r.key ORDER BY r.pos) AS n
    FROM k JOIN r ON r.key = k.key AND r.pos > k.pos AND r.t >= k.t + INTERVAL {hours} HOURS) WHERE n = 1)
SELECT ord, false AS unchecked FROM k"""


@register("stream_url_expiry", _expiring_sql(24))
def q_stream_url_expiry(spark, sf):
    """R2 with keyed state: two landings; a URL key comes again a day after it was last kept."""
    from ..streaming import ingest as ST
    from ..streaming import stateful as SF
    root = ST.scratch(spark, "expiry")
    arts = S.doc_articles(spark, sf).select("ord", "link", "published_at")
    t = ST.AppendTable(spark, f"{root}/table", "ord long, unchecked boolean")
    for n in range(2):
        arts.where(F.col("ord") % 2 == n).write.parquet(f"{root}/in/{n}")
        s = SF.first_per_key(spark.readStream.schema(arts.schema).parquet(f"{root}/in/*"), 24 * 3600, "30 days")
        SF.start(s.writeStream.outputMode("append").foreachBatch(lambda df, epoch: t.append(df, epoch))
                 .option("checkpointLocation", f"{root}/_checkpoint"), spark)
    return t.read()


@register("merge_table",
          f"SELECT ord, CASE WHEN ord % 3 = 1 THEN 'again ' || link ELSE link END AS link FROM ({O.page_articles_sql()}) WHERE ord % 5 <> 2")
def q_merge_table(spark, sf):
    """S10, U1 on merge-on-read: all pages written, a third of them written again, a fifth
    removed, folded into the base half-way."""
    from ..streaming import ingest as ST
    arts = S.page_articles(spark, sf).select("ord", "link")
    t = ST.MergeTable(spark, f"{ST.scratch(spark, 'merge')}/table", "ord long, link string", ["ord"], compact_after=2)
    t.write(arts, 0)
    t.write(arts.where(F.col("ord") % 3 == 1).withColumn("link", F.concat(F.lit("again "), "link")), 1)
    t.write(arts.limit(0), 2, gone=arts.where(F.col("ord") % 5 == 2))
    return t.read()


@register("stream_articles",
          O.greedy_keep_sql(O.dedup_keys_sql(f"SELECT (ord % 3) * 1000000000 + ord // 3 AS ord, title, link, source FROM ({O.page_articles_sql()})"))
          + "\nSELECT CAST(row_number() OVER (ORDER BY kept.ord) - 1 AS BIGINT) AS ord, CAST(kept.ord % 1000000000 AS BIGINT) "
          "AS batch_ord, a.link FROM kept JOIN (SELECT (ord % 3) * 1000000000 + ord // 3 AS ord, link FROM "
          f"({O.page_articles_sql()})) a ON a.ord = kept.ord")
def q_stream_articles(spark, sf):
    """R1+R2: three landings, one micro-batch each, whose own orders collide."""
    from ..streaming.ingest import AppendTable, scratch, stream_articles
    root = scratch(spark, "articles")
    arts = S.page_articles(spark, sf)
    t = AppendTable(spark, f"{root}/table", ", ".join(f"{c} {k}" for c, k in arts.dtypes) + ", batch_ord long")
    for n in range(3):
        arts.where(F.col("ord") % 3 == n).withColumn("ord", F.floor(F.col("ord") / 3)).write.parquet(f"{root}/in/{n}")
        stream_articles(spark, f"{root}/in/*", arts.schema, t, f"{root}/_checkpoint")
    return t.read().select("ord", "batch_ord", "link")


@register("stream_retention",
          f"SELECT ord, link FROM ({O.page_articles_sql()}) WHERE published_at >= TIMESTAMP '2024-01-03 00:00:00'")
def q_stream_retention(spark, sf):
    """Two micro-batches, one day kept, seen from 4 January."""
    from datetime import datetime

    from ..streaming.ingest import DayTable, scratch, stream_retention
    root = scratch(spark, "retention")
    arts = S.page_articles(spark, sf)
    t = DayTable(spark, f"{root}/table", ", ".join(f"{c} {k}" for c, k in arts.dtypes))
    for n in range(2):
        arts.where(F.col("ord") % 2 == n).write.parquet(f"{root}/in/{n}")
        stream_retention(spark, f"{root}/in/*", arts.schema, t, f"{root}/_checkpoint", days=1, as_of=lambda: datetime(2024, 1, 4))
    return t.read().select("ord", "link")


@register("table_replace",
          f"SELECT ord, link, CAST(0 AS BIGINT) AS rows_after_clear FROM ({O.page_articles_sql()}) WHERE ord % 2 = 1")
def q_table_replace(spark, sf):
    """A table written, replaced and cleared; what it held before the clearing."""
    from ..streaming.ingest import VersionedTable, scratch
    arts = S.page_articles(spark, sf).select("ord", "link")
    t = VersionedTable(spark, f"{scratch(spark, 'replace')}/table", "ord long, link string")
    t.append_version(arts)
    t.append_version(arts.where(F.col("ord") % 2 == 1))
    cleared = t.clear()
    return t.latest(before=cleared).withColumn("rows_after_clear", F.lit(t.latest().count()).cast("long"))


# ----------------------------------------------------------------------- XML round trips --

def _xml(c) -> F.Column:
    c = X.col_(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


XML_ROOT = ('<root xmlns:news="http://news.example/" xmlns:image="http://image.example/">', "</root>")


FILE_ENTRIES = 50      # entries of a landed file, as feeds have them; files grow in number


def _land_xml(spark, rows: DataFrame, name: str):
    """Writes (feed_ord, entry_ord, xml) as XML files of ``FILE_ENTRIES`` entries, in order, by as
    many tasks; returns the folder and the number of each file: feed and part (``_whole`` undoes it)."""
    from ..streaming.ingest import scratch
    at = scratch(spark, name)
    part = F.floor(F.col("entry_ord") / FILE_ENTRIES).cast("int")
    rows = rows.select((F.col("feed_ord") * 10_000_000 + part).cast("int").alias("feed_ord"), "entry_ord", "xml")
    ends = rows.select("feed_ord").distinct().select("feed_ord", F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("entry_ord"), F.lit(XML_ROOT[0]).alias("xml")),
        F.struct(F.lit(2 ** 62).alias("entry_ord"), F.lit(XML_ROOT[1]).alias("xml")))).alias("e")).select("feed_ord", "e.*")
    (rows.unionByName(ends).repartition("feed_ord").sortWithinPartitions("feed_ord", "entry_ord")
     .select("feed_ord", "xml").write.partitionBy("feed_ord").text(at))
    files = (spark.read.text(at).select(F.col("_metadata.file_path").alias("_file"), F.col("feed_ord").cast("int"))
             .distinct())
    return f"{at}/*", files


def _whole(entries: DataFrame) -> DataFrame:
    """feed_ord and entry_ord of entries that ``_land_xml`` has landed, over all files of a feed."""
    part = F.col("feed_ord") % 10_000_000
    return (entries.withColumn("entry_ord", (part * FILE_ENTRIES + F.col("entry_ord")).cast("long"))
            .withColumn("feed_ord", F.floor(F.col("feed_ord") / 10_000_000).cast("int")))


def _feed_positions(rows: DataFrame) -> DataFrame:
    """Adds ``entry_ord``: the place of each row by ``ord``, over all rows, from 0."""
    return U.assign_dense_ids(rows, "ord", -1, id_col="entry_ord")


def _pages_with_titles(spark, sf) -> DataFrame:
    p = S.page_articles(spark, sf)
    return p.select((F.col("ord") % 4).cast("int").alias("feed_ord"), F.floor(F.col("ord") / 4).cast("long").alias("entry_ord"),
                    "title", "link", "published_at")


def _xml_sql(extra: str = "") -> str:
    return (f"SELECT CAST(ord % 4 AS INTEGER) AS feed_ord, CAST(row_number() OVER (PARTITION BY ord % 4 ORDER BY ord) - 1 AS BIGINT) "
            f"AS entry_ord, nullif(title, '') AS title, link, {O.fmt_ts('published_at')} AS published_at{extra} FROM ({O.page_articles_sql()})")


@register("xml_rss_entries", _xml_sql())
def q_xml_rss_entries(spark, sf):
    """Pages written as RSS files and read back."""
    p = _pages_with_titles(spark, sf)
    xml = F.concat(F.lit("<item><title>"), _xml("title"), F.lit("</title><link>"), _xml("link"), F.lit("</link><pubDate>"),
                   F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate></item>"))
    path, files = _land_xml(spark, p.withColumn("xml", xml), "rss")
    r = _whole(FD.read_rss(spark, path, files))
    return r.select("feed_ord", "entry_ord", "title", "link", ts_str(NZ.parse_date("pubDate")).alias("published_at"))


@register("xml_atom_entries", _xml_sql())
def q_xml_atom_entries(spark, sf):
    """Pages written as Atom files (with another link before the right one) and read back."""
    p = _pages_with_titles(spark, sf)
    xml = F.concat(F.lit('<entry><title type="text">'), _xml("title"), F.lit('</title><link rel="self" href="https://self.example/"/>'
                   '<link rel="alternate" href="'), _xml("link"), F.lit('"/><published>'),
                   F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</published></entry>"))
    path, files = _land_xml(spark, p.withColumn("xml", xml), "atom")
    r = _whole(FD.read_atom(spark, path, files))
    return r.select("feed_ord", "entry_ord", "title", "link", ts_str(NZ.parse_date("published")).alias("published_at"))


def _stream_feeds_sql() -> str:
    return (f"SELECT CAST(ord % 4 AS INTEGER) AS feed_ord, CAST(ord // 4 AS BIGINT) AS entry_ord, nullif(title, '') AS title, link, "
            f"{O.fmt_ts('published_at')} AS published_at, CASE WHEN ord % 4 IN (1, 3) THEN 'https://img.example/' || ord END AS image, "
            f"CASE WHEN ord % 4 IN (1, 2) THEN 'tech' END AS term FROM ({O.page_articles_sql()})")


@register("stream_xml_feeds", _stream_feeds_sql())
def q_stream_xml_feeds(spark, sf):
    """Pages landed as feed files of 50 entries (RSS 2.0, RSS 1.0 with Dublin Core, Atom
    and RSS with a plain image) and read as a stream, at most 40 files a micro-batch."""
    from ..streaming import ingest as ST
    root = ST.scratch(spark, "feeds")
    p = S.page_articles(spark, sf).select("ord", "title", "link", "published_at")
    rfc, iso = F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    both = F.concat(F.lit("<title>"), _xml("title"), F.lit("</title><link>"), _xml("link"), F.lit("</link>"))
    image = F.concat(F.lit("https://img.example/"), F.col("ord").cast("string"))
    forms = [F.concat(F.lit("<item>"), both, F.lit("<pubDate>"), rfc, F.lit("</pubDate></item>")),
             F.concat(F.lit('<item rdf:about="x">'), both, F.lit("<dc:date>"), iso, F.lit("</dc:date><dc:subject>tech</dc:subject><image>"), image, F.lit("</image></item>")),
             F.concat(F.lit("<entry><title>"), _xml("title"), F.lit('</title><link rel="self" href="https://self.example/"/><link href="'), _xml("link"),
                      F.lit('"/><category term="tech"/><published>'), iso, F.lit("</published></entry>")),
             F.concat(F.lit("<item>"), both, F.lit("<pubDate>"), rfc, F.lit("</pubDate><image><url>"), image, F.lit("</url></image></item>"))]
    feed = F.col("ord") % 4
    xml = F.coalesce(*[F.when(feed == k, x) for k, x in enumerate(forms)])
    rows = p.select(feed.cast("int").alias("feed"), F.floor(F.col("ord") / 200).cast("long").alias("part"), "ord", xml.alias("xml"))
    # a feed file holds 50 entries, so as many tasks land files as there are files
    files = rows.groupBy("feed", "part").agg(F.concat(F.lit("<feed>"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ord", "xml"))), lambda e: e["xml"]), "\n"), F.lit("</feed>")).alias("value"))
    files.repartition("feed", "part").write.partitionBy("feed", "part").option("lineSep", "\n").text(f"{root}/in")
    entries = ST.feed_stream(spark, f"{root}/in", 40, "*.txt")
    t = ST.AppendTable(spark, f"{root}/table", "feed_ord int, entry_ord long, title string, link string, published_at string, image string, term string")
    number = lambda name: F.regexp_extract("_file", rf"/{name}=([0-9]+)/", 1).cast("long")
    out = entries.select(
        number("feed").cast("int").alias("feed_ord"), (number("part") * 50 + F.col("entry_ord")).alias("entry_ord"), "title", "link",
        ts_str(F.coalesce(*[NZ.parse_date(c) for c in ("published", "pubDate", "updated", "created")])).alias("published_at"),
        F.coalesce("image.href", "image.url").alias("image"), F.get("tags", 0)["term"].alias("term"))
    ST._run(out.writeStream.foreachBatch(lambda df, epoch: t.append(df, epoch)).option("checkpointLocation", f"{root}/_checkpoint"))
    return t.read()


@register("xml_sitemap_items",
          f"SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS entry_ord, link AS loc, nullif(title, '') AS title, 'https://img.example/1-' || ord AS image_loc "
          f"FROM ({O.page_articles_sql()})")
def q_xml_sitemap_items(spark, sf):
    """Pages written as a news sitemap with two images an entry and read back."""
    p = S.page_articles(spark, sf)
    image = lambda n: F.concat(F.lit(f"<image:image><image:loc>https://img.example/{n}-"), F.col("ord").cast("string"),
                               F.lit("</image:loc></image:image>"))
    xml = F.concat(F.lit("<url><loc>"), _xml("link"), F.lit("</loc><news:news><news:title>"), _xml("title"),
                   F.lit("</news:title></news:news>"), image(1), image(2), F.lit("</url>"))
    rows = _feed_positions(p.select("ord", xml.alias("xml")))
    path, files = _land_xml(spark, rows.select(F.lit(10).alias("feed_ord"), "entry_ord", "xml"), "sitemap")
    return _whole(FD.read_sitemap(spark, path, files)).select("entry_ord", "loc", "title", "image_loc")


# ---------------------------------------------------------------- labels, ids, selection --

@register("label_alias",
          "SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'negative' WHEN 1 THEN 'neutral' WHEN 2 THEN 'positive' "
          "WHEN 3 THEN 'positive' ELSE lower(event_type) END AS label FROM events")
def q_label_alias(spark, sf):
    """Model labels 0-2 and a name, and labels that are only lower-cased."""
    u = F.col("user_id") % 5
    raw = (F.when(u < 3, F.concat(F.lit("LABEL_"), u.cast("string"))).when(u == 3, F.lit("positive"))
           .otherwise(F.upper("event_type")))
    return S.table(spark, sf, "events").select("event_id", scoring.label_alias(raw).alias("label"))


@register("mention_article_ids",
          f"WITH {_store_cte()}\nSELECT pa.ord, s.id AS article_id FROM pa JOIN store s ON s.url = pa.link")
def q_mention_article_ids(spark, sf):
    """Records that name an article by its URL get its stored id."""
    a = S.page_articles(spark, sf).select("ord", F.col("link").alias("url"))
    ids = ST.articles_store(spark, sf).select("url", F.col("id").alias("article_id"))
    return a.join(ids, "url").select("ord", "article_id")


@register("summary_selected",
          f"SELECT doc_id, 'sumy-luhn' AS summarized_by, summary FROM ({_luhn_sql(100)}) UNION ALL "
          f"SELECT doc_id, 'truncate', {_truncate_sql('text', 100)} FROM documents")
def q_summary_selected(spark, sf):
    """Summarizers chosen by name."""
    d = S.table(spark, sf, "documents").select("doc_id", "text")
    chosen = [SM.configure_summarizer(n) for n in ("luhn", "truncate")]
    one, two = [s.summarize(d, "doc_id", "text", 100).select("doc_id", F.lit(s.name).alias("summarized_by"), "summary") for s in chosen]
    return one.unionByName(two)


# ------------------------------------------------------------- sitemap / lookup / model --

@register("sitemap_items",
          "SELECT 10 AS feed_ord, page_id AS entry_ord, CASE WHEN page_id % 3 = 0 THEN "
          r"regexp_replace(url, '(://[^/]+)/[a-z]{2}/', '\1/news/') ELSE url END AS loc, "
          "CASE WHEN page_id % 9 = 0 THEN ' ' ELSE "
          r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS title "
          "FROM pages QUALIFY row_number() OVER (ORDER BY page_id) <= 50")
def q_sitemap_items(spark, sf):
    it = NZ.cap_per_feed(FD.sitemap_items_from_pages(spark, sf))
    return it.select(F.col("feed_ord"), F.col("entry_ord"), "loc", "title")


@register("alias_lookup",
          f"WITH {O.mentions_sql(O.doc_mention_texts_sql())},\n"
          "cand AS (SELECT article_id, matched_text AS t FROM ments UNION ALL "
          f"SELECT doc_id, split_part({O.strip('text')}, ' ', 1) FROM documents)\n"
          f"SELECT cand.article_id, cand.t AS candidate, al.name AS company_name, al.ticker FROM cand "
          f"LEFT JOIN al ON al.alias = lower({O.strip('cand.t')})")
def q_alias_lookup(spark, sf):
    m = mentions.regex_mentions(_doc_texts(spark, sf)).select("article_id", F.col("matched_text").alias("t"))
    d = S.table(spark, sf, "documents").select(F.col("doc_id").alias("article_id"),
                                               F.split(X.strip_ws("text"), " ").getItem(0).alias("t"))
    out = mentions.alias_lookup(m.unionByName(d), "t")
    return out.select("article_id", F.col("t").alias("candidate"), "company_name", "ticker")


def _with_landed_spans(spark, sf) -> DataFrame:
    """Texts with the spans that an entity model has landed for every second one: the alias
    matches, each twice, and with a label that doesn't count at the text's start."""
    found = mentions.regex_mentions(_doc_texts(spark, sf)).where(F.col("article_id") % 2 == 0)
    span = F.struct("start_char", "end_char", F.lit("ORG").alias("label"), F.lit(0.85).alias("score"))
    other = F.struct(F.lit(0).cast("long").alias("start_char"), F.lit(3).cast("long").alias("end_char"),
                     F.lit("PERSON").alias("label"), F.lit(0.99).alias("score"))
    landed = found.groupBy("article_id").agg(F.collect_list(span).alias("s"))
    return (_doc_texts(spark, sf).join(landed, "article_id", "left")
            .withColumn("spans", F.when(F.col("s").isNotNull(), F.concat(F.array(other), F.col("s"), F.col("s")))).drop("s"))


def _landed_sql(where: str) -> str:
    cols = _MENT_COLS.replace("confidence", "CASE WHEN article_id % 2 = 0 THEN 0.85::DOUBLE ELSE confidence END AS confidence")
    return f"WITH {O.mentions_sql(O.doc_mention_texts_sql())}\nSELECT {cols} FROM ments WHERE {where}"


def _labelled_names(texts: DataFrame) -> DataFrame:
    """Texts with their names' spans, for the tagger: alias matches as labels."""
    found = mentions.regex_mentions(texts).groupBy("article_id").agg(F.collect_list(F.struct("start_char", "end_char")).alias("spans"))
    return texts.join(found, "article_id", "left")


def tagger_fold(article_id) -> F.Column:
    """True for the third of the texts that the tagger doesn't learn from."""
    return F.crc32(X.col_(article_id).cast("string").cast("binary")) % 3 == 1


@register("mention_model", "WITH " + O.mentions_sql(O.doc_mention_texts_sql())
          + f"\nSELECT {_MENT_COLS.replace('confidence', '0.85::DOUBLE AS confidence')} FROM ments")
def q_mention_model(spark, sf):
    """Names found by the tagger in every text, a third of which it has not learned from."""
    from ..operators import tagger
    texts = _doc_texts(spark, sf)
    model = tagger.fit(_labelled_names(texts.where(~F.coalesce(tagger_fold("article_id"), F.lit(False)))))
    return mentions.model_mentions(texts, model.loader())


@register("mention_landed", _landed_sql("article_id % 2 = 0"))
def q_mention_landed(spark, sf):
    """T8 from spans that a model has landed (for every second text here)."""
    return mentions.landed_mentions(_with_landed_spans(spark, sf), "spans")


@register("mention_fallback", _landed_sql("true"))
def q_mention_fallback(spark, sf):
    return mentions.extract_mentions(_with_landed_spans(spark, sf), spans_col="spans")


@register("learned_sentiment")
def q_learned_sentiment(spark, sf):
    """Every document scored out of fold by a model of ``labels`` (toxic: negative)."""
    from ..operators import calibrated
    labels = S.table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    s = calibrated.learned_sentiment(S.table(spark, sf, "documents"), labels)
    return s.select("doc_id", "fold", r9("negative").alias("negative"), r9("positive").alias("positive"), r9("compound").alias("compound"), "label")


# ------------------------------------------------------------------ T22, A7 ---------------

@register("text_sentiment",
          f"SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS text_length, round(positive - negative, 9) AS "
          f"compound, {O.label_sql()} AS label FROM (SELECT conv_id, turn, text, {O.lexicon_probs('text')} "
          "FROM conversations)")
def q_text_sentiment(spark, sf):
    """Sentiment and length of arbitrary text."""
    c = S.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    s = scoring.sentiment(c, "text")
    return s.select("conv_id", "turn", F.length("text").cast("long").alias("text_length"),
                    r9("compound").alias("compound"), "label")


@register("touched_companies",
          f"WITH em AS ({O.event_mentions_sql()}), batch AS (SELECT * FROM em WHERE created_at >= "
          "TIMESTAMP '2024-01-29'), touched AS (SELECT DISTINCT company_id FROM batch)\n"
          "SELECT strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, company_id, "
          "round(avg(sentiment_score), 9) AS avg_sentiment, CAST(count(*) AS BIGINT) AS article_volume "
          "FROM em WHERE company_id IN (SELECT company_id FROM touched) AND CAST(created_at AS DATE) IN "
          "(SELECT DISTINCT CAST(created_at AS DATE) FROM batch) GROUP BY 1, 2")
def q_touched_companies(spark, sf):
    """A7 -> A4: metrics recomputed only for the (day, company) pairs a batch touched."""
    from datetime import datetime
    em = S.event_mentions(spark, sf)
    batch = em.where(F.col("created_at") >= ts_lit(datetime(2024, 1, 29)))
    touched = batch.select("company_id").distinct()
    days = batch.select(F.to_date("created_at").alias("_d")).distinct()
    scope = (em.join(touched, "company_id", "left_semi")
             .join(days, F.to_date(em["created_at"]) == days["_d"], "left_semi"))
    d = M.daily_metrics(scope)
    return d.select("date", "company_id", r9("avg_sentiment").alias("avg_sentiment"), "article_volume")


def _stream_mentions_sql() -> str:
    return (f"WITH {_analysis_cte()}, c AS ({O.companies_sql()}),\n"
            "rows AS (SELECT an.key_pos AS ord, an.article_id, c.id AS company_id, an.sentiment_score, "
            "an.confidence AS confidence_score, an.context_sentence FROM an JOIN c USING (ticker)),\n"
            "r AS (SELECT *, max(confidence_score) OVER (PARTITION BY article_id, company_id ORDER BY ord "
            "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max FROM rows),\n"
            "rec AS (SELECT * FROM r WHERE prev_max IS NULL OR confidence_score > prev_max)\n"
            "SELECT article_id, company_id, round(list_reduce(list(sentiment_score ORDER BY ord), "
            "lambda a, b: (a + b) / 2), 9) AS sentiment_score, arg_max(confidence_score, ord) AS confidence_score, "
            "arg_max(context_sentence, ord) AS context_sentence FROM rec GROUP BY article_id, company_id")


@register("stream_company_mentions", _stream_mentions_sql())
def q_stream_company_mentions(spark, sf):
    """Documents arriving on a stream are analysed and their mentions folded and
    upserted (T15 -> J5 -> D7 -> U5) micro-batch by micro-batch."""
    from ..operators import reads
    from ..sources import dims as _d
    from ..streaming.ingest import mentions_via_stream

    def to_rows(texts):
        a = mentions.analyze_text(texts)
        return reads.mention_company_ids(a, _d.companies(texts.sparkSession)).select(
            F.col("key_pos").alias("ord"), "article_id", "company_id", "sentiment_score", "confidence_score",
            "context_sentence")

    t = mentions_via_stream(spark, sf, "documents.parquet", S.docs_to_mention_texts, to_rows)
    return t.select("article_id", "company_id", r9("sentiment_score").alias("sentiment_score"),
                    "confidence_score", "context_sentence")
