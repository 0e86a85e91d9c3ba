"""HTML column expressions: images, og:image, main text, consent-banner strip.

Built-in regex functions only, so the work stays inside whole-stage codegen; no
per-row Python. Patterns avoid back-references so RE2 can run the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import BANNER_KEYWORDS
from .text import col_, collapse_ws, strip_ws

# --- fixed values: patterns for image discovery -------------------------------------
OG_PROPERTY_FIRST = r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""
OG_CONTENT_FIRST = r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']"""
IMG_SRC = r"""(?i)<img[^>]+(?:src|data-src)=["']([^"']+)["']"""
IMG_SRCSET = r"""(?i)<img[^>]+srcset=["']([^"']+)["']"""
# -------------------------------------------------------------------------------------

# Elements whose whole body is boilerplate for main-text extraction (tables are off).
DROP_ELEMENTS = ("script", "style", "noscript", "template", "svg", "iframe", "nav",
                 "header", "footer", "aside", "form", "table")
BLOCK_TAGS = "p|div|br|h[1-6]|li|ul|ol|tr|blockquote|section|article|pre|dd|dt|main"


def og_image(html) -> Column:
    """Og:image content, property-first order tried before content-first."""
    h = col_(html)
    return F.coalesce(F.nullif(F.regexp_extract(h, OG_PROPERTY_FIRST, 1), F.lit("")),
                      F.nullif(F.regexp_extract(h, OG_CONTENT_FIRST, 1), F.lit("")))


def _image_candidate(h: Column, pattern: str) -> Column:
    url = strip_ws(F.regexp_extract(h, pattern, 1))
    url = F.when(url.contains(" "),
                 strip_ws(F.substring_index(F.substring_index(url, ",", 1), " ", 1))).otherwise(url)
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    return F.nullif(url, F.lit(""))


def html_image(html) -> Column:
    """First <img> src/data-src, else first srcset candidate; '//x' -> 'https://x'.

    A src that strips to empty falls through to the srcset pattern.
    """
    h = col_(html)
    first = F.nullif(strip_ws(F.regexp_extract(h, IMG_SRC, 1)), F.lit(""))
    return F.when(first.isNotNull(), _image_candidate(h, IMG_SRC)).otherwise(
        _image_candidate(h, IMG_SRCSET))


def _main_region(html) -> Column:
    h = F.regexp_replace(col_(html), r"(?s)<!--.*?-->", "")
    for tag in DROP_ELEMENTS:
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}[ \t\r\n]*>", "")
    return h


def _region_lines(h: Column) -> Column:
    region = F.coalesce(
        F.nullif(F.regexp_extract(h, r"(?is)<article\b[^>]*>(.*)</article[ \t\r\n]*>", 1), F.lit("")),
        F.nullif(F.regexp_extract(h, r"(?is)<body\b[^>]*>(.*)</body[ \t\r\n]*>", 1), F.lit("")),
        h)
    region = F.regexp_replace(region, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    region = F.regexp_replace(region, r"<[^>]+>", "")
    return region


_NUMERIC = r"&#(?:[xX]([0-9a-fA-F]{1,6})|([0-9]{1,7}));"
_NAMED = r"&([A-Za-z][A-Za-z0-9]{1,31});"


def _from_code(code: Column) -> Column:
    """Character of a code point; null where there is none."""
    ok = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(ok, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def decode_entities(text: Column) -> Column:
    """Numeric and named character references, each decoded once; unknown ones stay. The text
    between references is split off and joined again with what they stand for."""
    from html.entities import name2codepoint
    names = F.create_map(*[F.lit(x) for k, v in {**name2codepoint, "apos": 39}.items() for x in (k, chr(v))])
    both = f"(?:{_NUMERIC}|{_NAMED})"

    def of(ref: Column) -> Column:
        code = F.coalesce(F.conv(F.nullif(F.regexp_extract(ref, _NUMERIC, 1), F.lit("")), 16, 10),
                          F.nullif(F.regexp_extract(ref, _NUMERIC, 2), F.lit(""))).cast("long")
        return F.coalesce(_from_code(code), F.try_element_at(names, F.regexp_extract(ref, _NAMED, 1)), ref)

    refs = F.transform(F.regexp_extract_all(text, F.lit(f"({both})"), F.lit(1)), of)
    joined = F.array_join(F.zip_with(F.split(text, both, -1), refs, lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))), "")
    return F.when(text.contains("&") & text.rlike(both), joined).otherwise(text)


def with_main_text(df: DataFrame, html_col: str, out: str) -> DataFrame:
    """T2 (native form): main text of a page, one paragraph per line, repeats removed.

    Comments and boilerplate elements go first, then the <article> region (else
    <body>, else the whole document) is kept; block tags become line breaks, the
    remaining tags are dropped, character references decoded, each line whitespace-
    collapsed, blank and repeated lines removed. Empty result -> null.

    Staged projections keep each expensive intermediate evaluated once per row.
    """
    df = df.withColumn("_mt_h", _main_region(F.col(html_col)))
    df = df.withColumn("_mt_r", _region_lines(F.col("_mt_h")))
    df = df.withColumn("_mt_r", decode_entities(F.col("_mt_r")))
    lines = F.transform(F.split(F.col("_mt_r"), "\n"), lambda l: collapse_ws(l))
    lines = F.array_distinct(F.filter(lines, lambda l: l != ""))
    return df.withColumn(out, F.nullif(F.array_join(lines, "\n"), F.lit(""))).drop("_mt_h", "_mt_r")


def banner_pattern() -> str:
    return "|".join(k.replace("-", r"\-") for k in BANNER_KEYWORDS)


def with_banner_strip(df: DataFrame, content_col: str, out: str) -> DataFrame:
    """Drop a leading consent banner.

    Keyword lines are found on the lowered, stripped line. Scanning stops after the
    first keyword line once six lines pass without another, so the banner is the
    chain of keyword lines that are at most six apart, starting at the first one.
    Everything through its last line goes, then lines shorter than 20 stripped
    chars; if nothing is left the text is kept as it was.
    """
    pat = banner_pattern()
    # one pass over the whole text first: only texts holding a keyword are split into lines
    has_kw = F.lower(F.col(content_col)).rlike(pat)
    df = df.withColumn("_bs_l", F.when(has_kw, F.split(F.col(content_col), "\n")))
    df = df.withColumn("_bs_k", F.filter(
        F.transform("_bs_l", lambda l, i: F.when(F.lower(strip_ws(l)).rlike(pat), i)),
        lambda x: x.isNotNull()))
    df = df.withColumn("_bs_last", F.get(F.filter(
        "_bs_k", lambda k, j: (j == F.size("_bs_k") - 1) | (F.get(F.col("_bs_k"), j + 1) - k > 6)), 0))
    df = df.withColumn("_bs_start", F.get(F.filter(
        F.transform("_bs_l", lambda l, i: F.when((i > F.col("_bs_last")) & (F.length(strip_ws(l)) >= 20), i)),
        lambda x: x.isNotNull()), 0))
    c = F.col(content_col)
    stripped = strip_ws(F.array_join(F.slice("_bs_l", F.col("_bs_start") + 1, F.size("_bs_l")), "\n"))
    res = F.when(c.isNull() | (c == "") | F.col("_bs_last").isNull() | F.col("_bs_start").isNull(), c) \
        .otherwise(stripped)
    return df.withColumn(out, res).drop("_bs_l", "_bs_k", "_bs_last", "_bs_start")
