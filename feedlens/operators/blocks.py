"""Main text by blocks (T2): text and link density per block, templates by host.

A page's tag stream is cut at block elements. A block is long when it has ``LONG_WORDS`` words
or more and at most a third of its characters are link text; a short one that isn't mostly
links counts if it stands next to a long one (headings, captions, one-line paragraphs).
Navigation, teasers and link lists fall out by their density, wherever they stand.

What a host repeats is template: a block found in ``REPEATS`` or more different page bodies of
a host is dropped from all its pages. Digests are counted, never texts compared; copies of one
page are one body, so a page that landed often keeps its text. A page whose blocks are all
template keeps them.

Null pages give null, pages without text null, repeated blocks of a page count once, a hot host
or a block that very many pages hold is counted by digest before the shuffle and joined back
against a checkpointed table, which Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import decode_entities
from ..functions.text import collapse_ws, host_of
from ..session import cut_lineage

LONG_WORDS = 10
REPEATS = 3
# elements without text of their own, and those that end a block
SILENT = ("head", "script", "style", "noscript", "template", "svg", "iframe", "select", "button")
BREAKS = ("address|article|aside|blockquote|body|br|caption|center|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|"
          "li|main|nav|ol|option|p|pre|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul")
LINK, END = "\u0001", "\u0002"


def with_blocks(pages: DataFrame, html_col: str, into: str) -> DataFrame:
    """Adds ``into``: the page's blocks in order, array of (text, words, chars, link_chars)."""
    h = F.regexp_replace(F.translate(F.col(html_col), LINK + END, ""), r"(?s)<!--.*?-->", "")
    for name in SILENT:
        h = F.regexp_replace(h, rf"(?is)<{name}\b[^>]*>.*?</{name}[ \t\r\n]*>", "")
    h = F.regexp_replace(h, r"(?i)<a\b[^>]*>", LINK)
    h = F.regexp_replace(h, r"(?i)</a[ \t\r\n]*>", END)
    h = F.regexp_replace(h, rf"(?i)</?(?:{BREAKS})\b[^>]*>", "\n")
    d = pages.withColumn("_bl", F.regexp_replace(h, r"<[^>]+>", ""))
    d = d.withColumn("_bl", F.split(decode_entities(F.col("_bl")), "\n"))

    def block(line):
        text = collapse_ws(F.regexp_replace(line, f"[{LINK}{END}]", ""))
        links = F.transform(F.regexp_extract_all(line, F.lit(f"{LINK}([^{LINK}{END}]*)"), F.lit(1)), lambda x: F.length(collapse_ws(x)))
        return F.struct(text.alias("text"), F.size(F.split(text, " ")).alias("words"), F.length(text).alias("chars"),
                        F.aggregate(links, F.lit(0), lambda a, x: a + x).alias("link_chars"))
    return d.withColumn(into, F.filter(F.transform("_bl", block), lambda b: b["text"] != "")).drop("_bl")


def with_content_blocks(pages: DataFrame, blocks: str, into: str) -> DataFrame:
    """Adds ``into``: the texts of the blocks that count as content, in order, each once."""
    d = pages.withColumn("_words", F.transform(blocks, lambda b: 3 * b["link_chars"] <= b["chars"]))
    d = d.withColumn("_long", F.transform(blocks, lambda b: (3 * b["link_chars"] <= b["chars"]) & (b["words"] >= LONG_WORDS)))

    def near(i):
        return (F.coalesce(F.get("_long", i - 1), F.lit(False)) | F.coalesce(F.get("_long", i + 1), F.lit(False)))
    keep = F.filter(F.transform(blocks, lambda b, i: F.when(F.get("_long", i) | (F.get("_words", i) & near(i)), b["text"])), lambda t: t.isNotNull())
    return d.withColumn(into, F.array_distinct(keep)).drop("_words", "_long")


def main_blocks(pages: DataFrame, url_col: str = "url", html_col: str = "html", repeats: int = REPEATS) -> DataFrame:
    """The rows of ``pages`` (without the page) and ``content``: their content blocks, one a
    line, without what the host repeats."""
    rest = [c for c in pages.columns if c != html_col]
    d = with_content_blocks(with_blocks(pages, html_col, "_blocks"), "_blocks", "_texts").drop(html_col, "_blocks")
    d = cut_lineage(d.withColumn("_row", F.monotonically_increasing_id()))
    whole = F.nullif(F.array_join("_texts", "\n"), F.lit(""))
    lines = d.select("_row", host_of(url_col).alias("_host"), F.md5(whole).alias("_body"), F.posexplode("_texts").alias("_pos", "_text"))
    refs = lines.select("_row", "_host", "_body", "_pos", F.unhex(F.md5("_text")).alias("_digest"))
    template = (refs.select("_host", "_digest", "_body").distinct().groupBy("_host", "_digest").agg(F.count(F.lit(1)).alias("n"))
                .where(F.col("n") >= repeats).drop("n"))
    own = refs.join(cut_lineage(template), ["_host", "_digest"], "left_anti").groupBy("_row").agg(F.collect_set("_pos").alias("_own"))
    out = d.join(own, "_row", "left")
    kept = F.nullif(F.array_join(F.filter("_texts", lambda t, i: F.array_contains("_own", i)), "\n"), F.lit(""))
    return out.select(*rest, F.coalesce(kept, whole).alias("content"))


def main_blocks_sql(pages: str) -> str:
    """The same rule for DuckDB, with element lists of its own; ``pages``: page_id, url, html."""
    silent = "head script style noscript template svg iframe select button".split()
    h = r"regexp_replace(translate(html, chr(1) || chr(2), ''), '(?s)<!--.*?-->', '', 'g')"
    for name in silent:
        h = rf"regexp_replace({h}, '(?is)<{name}\b[^>]*>.*?</{name}[ \t\r\n]*>', '', 'g')"
    h = rf"regexp_replace(regexp_replace({h}, '(?i)<a\b[^>]*>', chr(1), 'g'), '(?i)</a[ \t\r\n]*>', chr(2), 'g')"
    h = (rf"regexp_replace({h}, '(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dd|dt|td|th|tr|tbody|thead|tfoot|table|caption|nav|main|pre|form|body|html|title|aside|"
         rf"header|footer|figure|figcaption|section|article|summary|details|fieldset|option|address|center|blockquote|h[1-6])\b[^>]*>', chr(10), 'g')")
    h = rf"regexp_replace({h}, '<[^>]+>', '', 'g')"
    for ref, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        h = f"replace({h}, '{ref}', '{c}')"
    from ..oracle import collapse, host_of as host_sql
    return f"""
WITH l AS (SELECT page_id, url, unnest(string_split({h}, chr(10))) AS line, generate_subscripts(string_split({h}, chr(10)), 1) AS i FROM ({pages})),
b AS (SELECT page_id, url, i, {collapse("regexp_replace(line, '[' || chr(1) || chr(2) || ']', '', 'g')")} AS t,
  list_sum(list_transform(regexp_extract_all(line, chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1), lambda x: length({collapse('x')}))) AS k FROM l),
w AS (SELECT *, 3 * coalesce(k, 0) <= length(t) AS text_, len(string_split(t, ' ')) >= {LONG_WORDS} AND 3 * coalesce(k, 0) <= length(t) AS long_ FROM b WHERE t <> ''),
n AS (SELECT *, coalesce(lag(long_) OVER o, false) OR coalesce(lead(long_) OVER o, false) AS near_ FROM w WINDOW o AS (PARTITION BY page_id ORDER BY i)),
c AS (SELECT page_id, url, t, min(i) AS i FROM n WHERE long_ OR (text_ AND near_) GROUP BY ALL),
p AS (SELECT page_id, any_value({host_sql('url')}) AS host, string_agg(t, chr(10) ORDER BY i) AS whole FROM c GROUP BY page_id),
x AS (SELECT host, t FROM c JOIN p USING (page_id) GROUP BY host, t HAVING count(DISTINCT whole) >= {REPEATS}),
k AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS own FROM c JOIN p USING (page_id) WHERE NOT EXISTS (FROM x WHERE x.host = p.host AND x.t = c.t) GROUP BY page_id)
SELECT page_id, coalesce(own, whole) AS content FROM ({pages}) LEFT JOIN p USING (page_id) LEFT JOIN k USING (page_id)"""
