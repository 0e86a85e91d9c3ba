"""DuckDB SQL twins of the Spark expressions, used only to build ``oracle_sql()``.

Each helper returns SQL text that computes the same value as the Spark column of the
same name. It re-states the rule in SQL rather than calling the Spark plan, with element
lists and patterns of its own; fixture texts, dimensions and the alias list are the inputs
that both sides share.
"""

from __future__ import annotations

from .sources.dims import (BANNER_KEYWORDS, COMPANIES, COMPANY_ALIASES, alias_pattern)
from .sources.tables import DOC_SUFFIXES, PAGE_BANNERS

# --- fixed values: what the rules name, written out for SQL ------------------------------
DROP_ELEMENTS = "script style noscript template svg iframe nav header footer aside form table".split()
BLOCK_TAGS = "p|div|br|h1|h2|h3|h4|h5|h6|li|ul|ol|tr|blockquote|section|article|pre|dd|dt|main"
OG_PROPERTY_FIRST = r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""
OG_CONTENT_FIRST = r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']"""
IMG_SRC = r"""(?i)<img[^>]+(?:data-src|src)=["']([^"']+)["']"""
IMG_SRCSET = r"""(?i)<img[^>]+srcset=["']([^"']+)["']"""
# white space as str.strip() knows it: the ASCII separators and Unicode spaces
WS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
SCHEME = r"[a-zA-Z][a-zA-Z0-9+.\-]*"
# -------------------------------------------------------------------------------------

WS_RUN = WS + "+"
# the character references that the fixture pages hold
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def strip(x: str) -> str:
    return rr(x, rf"\A{WS_RUN}|{WS_RUN}\z")


def collapse(x: str) -> str:
    return strip(rr(x, WS_RUN, " "))


def clean_html(x: str) -> str:
    return collapse(rr(x, r"<[^>]+>"))


def normalize_url(x: str) -> str:
    u = rr(f"lower({strip(x)})", r"/+\z")
    return f"split_part(split_part({u}, '?', 1), '#', 1)"


def normalize_title(x: str) -> str:
    return collapse(f"lower({x})")


def netloc(x: str) -> str:
    return f"regexp_extract({x}, {q(rf'\A(?:{SCHEME}:)?//([^/?#]*)')}, 1)"


def url_path(x: str) -> str:
    rest = rr(rr(x, rf"\A{SCHEME}:"), r"\A//[^/?#]*")
    return f"regexp_extract({rest}, '\\A([^?#]*)', 1)"


def url_domain(x: str) -> str:
    return f"CASE WHEN {netloc(x)} <> '' THEN {netloc(x)} ELSE split_part({url_path(x)}, '/', 1) END"


def host_of(x: str) -> str:
    return f"regexp_extract({x}, {q(rf'\A{SCHEME}://([^/?#:]*)')}, 1)"


def ts_hours(n: str) -> str:
    return f"(TIMESTAMP '2024-01-01 00:00:00' + ({n}) * INTERVAL 1 HOUR)"


def fmt_ts(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%f')"


def nullif_empty(x: str) -> str:
    return f"nullif({x}, '')"


def pick(values, idx_expr: str) -> str:
    """values[idx] for a fixed list of strings (idx 0-based)."""
    arms = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE {idx_expr} {arms} END)"


# --- stand-in views --------------------------------------------------------------------

def page_articles_sql() -> str:
    title = collapse(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
    body = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
    return f"""SELECT page_id AS ord, {title} AS title, url AS link, {host_of('url')} AS source,
      {ts_hours('page_id % 97')} AS published_at, left({clean_html(body)}, 500) AS description,
      CAST(NULL AS VARCHAR) AS image, CAST(NULL AS VARCHAR) AS category,
      CAST(NULL AS VARCHAR) AS content, false AS content_extracted FROM pages"""


def doc_link(x: str) -> str:
    return f"('https://docs.example/' || md5(lower({x})))"


def doc_articles_sql() -> str:
    return f"""SELECT doc_id AS ord, {strip("split_part(text, chr(10), 1)")} AS title,
      {doc_link('text')} AS link, source, {ts_hours('doc_id % 89')} AS published_at,
      left({collapse('text')}, 500) AS description, CAST(NULL AS VARCHAR) AS image,
      lang AS category, text AS content, true AS content_extracted FROM documents"""


def doc_mention_texts_sql() -> str:
    return f"""SELECT doc_id AS article_id, {strip("split_part(text, chr(10), 1)")} AS title,
      text || {pick(DOC_SUFFIXES, 'doc_id % 8')} AS text, source FROM documents"""


def page_fixture_sql() -> str:
    og = ("CASE WHEN page_id % 4 = 0 THEN '<meta property=\"og:image\" content=\"https://img.example/og/' "
          "|| page_id || '.jpg\">' WHEN page_id % 4 = 1 THEN '<meta content=''https://img.example/og/' "
          "|| page_id || '.png'' property=''og:image''>' ELSE '' END")
    img = ("CASE WHEN page_id % 5 = 0 THEN '<img src=\"//cdn.example/p' || page_id || '.jpg\" alt=\"x\">' "
           "WHEN page_id % 5 = 1 THEN '<img alt=\"y\" srcset=\"https://cdn.example/p' || page_id || "
           "'-320.jpg 320w, https://cdn.example/p' || page_id || '-640.jpg 640w\">' "
           "WHEN page_id % 5 = 2 THEN '<img data-src='' /img/' || page_id || '.png ''>' ELSE '' END")
    banner = pick(PAGE_BANNERS, "page_id % 6")
    html = f"replace(replace(html, '</head>', ({og}) || '</head>'), '<article>', '<article>' || {banner} || ({img}))"
    return f"SELECT page_id, url, {html} AS html FROM pages"


def event_mentions_sql() -> str:
    return """SELECT event_id AS ord, event_id % 500 AS article_id, user_id % 7 + 1 AS company_id,
      greatest(-1.0, least(1.0, (value - 50.0) / 50.0)) AS sentiment_score,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100.0 AS confidence_score,
      event_type || ' event ' || CAST(event_id AS VARCHAR) AS context_sentence,
      ts AS created_at FROM events"""


def companies_sql() -> str:
    rows = ", ".join(f"(CAST({i + 1} AS BIGINT), {q(n)}, {q(t)}, {q(u)})" for i, (n, t, u) in enumerate(COMPANIES))
    return f"SELECT * FROM (VALUES {rows}) AS c(id, name, ticker, icon_url)"


def aliases_sql() -> str:
    from .sources.dims import AMBIGUOUS_ALIASES
    rows = ", ".join(f"({q(a)}, {q(n)}, {q(t)}, {i}, {str(a in AMBIGUOUS_ALIASES).lower()})"
                     for i, (a, n, t) in enumerate(COMPANY_ALIASES))
    return f"SELECT * FROM (VALUES {rows}) AS a(alias, name, ticker, ord, ambiguous)"


# --- greedy two-key dedup (exact, recursive) -------------------------------------------

def greedy_keep_sql(keys_sql: str) -> str:
    """Recursive CTE body giving the kept ``ord`` values of ``keys_sql`` (ord, uk, tk)."""
    return f"""WITH RECURSIVE base AS ({keys_sql}),
st(it, ord, uk, tk, status) AS (
  SELECT 0, ord, uk, tk, 0 FROM base
  UNION ALL
  SELECT it + 1, ord, uk, tk, CASE WHEN s1 = 1 THEN 1 WHEN bu OR bt THEN 2 ELSE 0 END FROM (
    SELECT *, bool_or(s1 = 1) OVER (PARTITION BY uk) AS bu,
              bool_or(s1 = 1) OVER (PARTITION BY tk) AS bt FROM (
      SELECT *, CASE WHEN status = 1 OR (ord = mu AND ord = mt) THEN 1 ELSE 0 END AS s1 FROM (
        SELECT *, min(ord) FILTER (WHERE status = 0) OVER (PARTITION BY uk) AS mu,
                  min(ord) FILTER (WHERE status = 0) OVER (PARTITION BY tk) AS mt,
                  count(*) FILTER (WHERE status = 0) OVER () AS n_und FROM st) a
      WHERE n_und > 0) b) c
  WHERE NOT (s1 = 0 AND (bu OR bt))
),
kept AS (SELECT ord FROM st WHERE status = 1 AND it = (SELECT max(it) FROM st))"""


def dedup_keys_sql(src: str, ord_expr: str = "ord") -> str:
    tk = f"{normalize_title('title')} || chr(0) || lower(source)"
    return f"SELECT {ord_expr} AS ord, {normalize_url('link')} AS uk, {tk} AS tk FROM ({src}) s"


# --- html -------------------------------------------------------------------------------

def og_image(x: str) -> str:
    return (f"coalesce(nullif(regexp_extract({x}, {q(OG_PROPERTY_FIRST)}, 1), ''), "
            f"nullif(regexp_extract({x}, {q(OG_CONTENT_FIRST)}, 1), ''))")


def _img_candidate(x: str, pat: str) -> str:
    u = strip(f"regexp_extract({x}, {q(pat)}, 1)")
    u = f"(CASE WHEN contains({u}, ' ') THEN {strip(f'split_part(split_part({u}, {q(",")}, 1), {q(" ")}, 1)')} ELSE {u} END)"
    u = f"(CASE WHEN starts_with({u}, '//') THEN 'https:' || {u} ELSE {u} END)"
    return f"nullif({u}, '')"


def html_image(x: str) -> str:
    first = f"nullif({strip(f'regexp_extract({x}, {q(IMG_SRC)}, 1)')}, '')"
    return (f"(CASE WHEN {first} IS NOT NULL THEN {_img_candidate(x, IMG_SRC)} "
            f"ELSE {_img_candidate(x, IMG_SRCSET)} END)")


def main_text(x: str) -> str:
    h = rr(x, r"(?s)<!--.*?-->")
    for tag in DROP_ELEMENTS:
        h = rr(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}[ \t\r\n]*>")
    region = (f"coalesce(nullif(regexp_extract(h1, {q(r'(?is)<article\b[^>]*>(.*)</article[ \t\r\n]*>')}, 1), ''), "
              f"nullif(regexp_extract(h1, {q(r'(?is)<body\b[^>]*>(.*)</body[ \t\r\n]*>')}, 1), ''), h1)")
    r = rr(region, rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", "\n")
    r = rr(r, r"<[^>]+>")
    for ent, ch in ENTITIES:
        r = f"replace({r}, {q(ent)}, {q(ch)})"
    lines = f"list_filter(list_transform(string_split({r}, chr(10)), lambda l: {collapse('l')}), lambda l: l <> '')"
    dist = f"list_filter(ls, lambda x, i: list_position(ls, x) = i)"
    return (f"(SELECT nullif(array_to_string({dist}, chr(10)), '') FROM "
            f"(SELECT {lines} AS ls FROM (SELECT {h} AS h1)))")


def banner_strip(x: str) -> str:
    pat = "|".join(k.replace("-", r"\-") for k in BANNER_KEYWORDS)
    # lines are 1-based in DuckDB lists; indexes below are converted to 0-based
    return f"""(SELECT CASE WHEN c IS NULL OR c = '' OR lst IS NULL OR st IS NULL THEN c
        ELSE {strip("array_to_string(ls[st + 1:], chr(10))")} END FROM (
      SELECT c, ls, lst,
        (list_filter(list_transform(ls, lambda l, i: CASE WHEN i - 1 > lst AND length({strip('l')}) >= 20
                                       THEN i - 1 END), lambda v: v IS NOT NULL))[1] AS st FROM (
        SELECT c, ls, (list_filter(kw, lambda k, j: j = len(kw) OR kw[j + 1] - k > 6))[1] AS lst FROM (
          SELECT c, ls, list_filter(list_transform(ls, lambda l, i:
              CASE WHEN regexp_matches(lower({strip('l')}), {q(pat)}) THEN i - 1 END), lambda v: v IS NOT NULL) AS kw
          FROM (SELECT {x} AS c, string_split({x}, chr(10)) AS ls)))))"""


ALIAS_PATTERN = "(?i)" + alias_pattern()


# --- sentences, mentions, scoring -------------------------------------------------------

SENT_SEP_SQL = r"[.!?](" + WS_RUN + ")"


def sentences_list(x: str) -> str:
    """RE2 has no look-behind: mark each separator after . ! ? with chr(1), split on it."""
    marked = f"regexp_replace({x}, {q('([.!?])' + WS_RUN)}, '\\1' || chr(1), 'g')"
    return f"string_split({marked}, chr(1))"


def mentions_sql(src: str, compat: bool = False) -> str:
    """CTE chain ``ments`` (article_id, company_name, ticker, matched_text, start_char,
    end_char, confidence, context_sentence) for texts ``src`` (article_id, text)."""
    pat = q(ALIAS_PATTERN)
    sep_len = "1" if compat else "coalesce(length(seps[k]), 0)"
    return f"""t AS ({src}),
m AS (SELECT article_id, text, regexp_extract_all(text, {pat}, 1) AS ms,
             regexp_split_to_array(text, {pat}) AS gs FROM t),
e AS (SELECT article_id, text, i, ms[i] AS mt, gs[i] AS g
      FROM (SELECT article_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM m)),
e2 AS (SELECT article_id, text, i, mt,
         CAST(coalesce(sum(length(g) + length(mt)) OVER (PARTITION BY article_id ORDER BY i
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(g) AS BIGINT) AS start_char FROM e),
sp AS (SELECT article_id, {sentences_list('text')} AS ss,
              regexp_extract_all(text, {q(SENT_SEP_SQL)}, 1) AS seps FROM t),
s1 AS (SELECT article_id, k, ss[k] AS sent, {sep_len} AS sep_len
       FROM (SELECT article_id, ss, seps, unnest(range(1, len(ss) + 1)) AS k FROM sp)),
s2 AS (SELECT article_id, k, sent, CAST(coalesce(sum(length(sent) + sep_len) OVER (PARTITION BY article_id
         ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s_start FROM s1),
jk AS (SELECT e2.article_id, e2.i, max(s2.k) AS k FROM e2 JOIN s2 ON e2.article_id = s2.article_id
       AND s2.s_start <= e2.start_char GROUP BY e2.article_id, e2.i),
ctx AS (SELECT e2.article_id, e2.i, e2.mt, e2.start_char, e2.start_char + length(e2.mt) AS end_char,
          left(CASE WHEN s2.k IS NOT NULL AND e2.start_char < s2.s_start + length(s2.sent) THEN {strip('s2.sent')}
               ELSE {strip('substr(e2.text, greatest(e2.start_char - 100, 0) + 1, e2.start_char + length(e2.mt) + 100 - greatest(e2.start_char - 100, 0))')}
               END, 500) AS context_sentence
        FROM e2 LEFT JOIN jk USING (article_id, i) LEFT JOIN s2 ON s2.article_id = e2.article_id AND s2.k = jk.k),
al AS ({aliases_sql()}),
ments AS (SELECT ctx.article_id, al.name AS company_name, al.ticker, ctx.mt AS matched_text,
            CAST(ctx.start_char AS BIGINT) AS start_char, CAST(ctx.end_char AS BIGINT) AS end_char,
            CAST(0.9 AS DOUBLE) AS confidence, ctx.context_sentence
          FROM ctx JOIN al ON al.alias = lower({strip('ctx.mt')}))"""


def mention_dedup_sql() -> str:
    """CTE ``uniq`` after ``ments``: D6."""
    return """uniq AS (SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY article_id, ticker, left(context_sentence, 100)
                                 ORDER BY confidence DESC, start_char) AS rn,
              min(start_char) OVER (PARTITION BY article_id, ticker, left(context_sentence, 100)) AS key_pos
    FROM ments) WHERE rn = 1)"""


def lexicon_probs(x: str) -> str:
    """Columns negative, neutral, positive of the lexicon scorer (blank -> 0, 1, 0)."""
    from .operators.scoring import NEGATIVE_WORDS, POSITIVE_WORDS, TOKEN_SPLIT
    toks = f"regexp_split_to_array(lower({x}), {q(TOKEN_SPLIT)})"
    pos_l = "[" + ", ".join(q(w) for w in POSITIVE_WORDS) + "]"
    neg_l = "[" + ", ".join(q(w) for w in NEGATIVE_WORDS) + "]"
    p = f"CAST(len(list_filter({toks}, lambda w: list_contains({pos_l}, w))) AS DOUBLE)"
    n = f"CAST(len(list_filter({toks}, lambda w: list_contains({neg_l}, w))) AS DOUBLE)"
    blank = f"({x} IS NULL OR {strip(x)} = '')"
    return (f"CASE WHEN {blank} THEN 0.0 ELSE {n} / ({p} + {n} + 1.0) END AS negative, "
            f"CASE WHEN {blank} THEN 1.0 ELSE 1.0 / ({p} + {n} + 1.0) END AS neutral, "
            f"CASE WHEN {blank} THEN 0.0 ELSE {p} / ({p} + {n} + 1.0) END AS positive")


def label_sql(pos: str = "positive", neg: str = "negative", neu: str = "neutral") -> str:
    return (f"CASE WHEN {pos} >= {neg} AND {pos} >= {neu} THEN 'positive' "
            f"WHEN {neg} >= {pos} AND {neg} >= {neu} THEN 'negative' ELSE 'neutral' END")


def winning_sql(pos: str = "positive", neg: str = "negative", neu: str = "neutral") -> str:
    return (f"CASE WHEN {pos} >= {neg} AND {pos} >= {neu} THEN {pos} "
            f"WHEN {neg} >= {pos} AND {neg} >= {neu} THEN {neg} ELSE {neu} END")


# --- raw feed entries and normalization ---------------------------------------------------

def raw_items_sql() -> str:
    ts = "(TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL 1 HOUR)"
    title = r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"
    body = r"regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)"
    m6 = "page_id % 6"
    forms = ["%a, %d %b %Y %H:%M:%S +0000", "%a, %d %b %Y %H:%M:%S EST", "%d %b %Y %H:%M +0100",
             "%A, %d %B %Y %H:%M:%S GMT", "%a, %d %b %y %H:%M:%S +0000", "%a, %d %b %Y %H:%M:%S +00:00",
             "%b %-d, %Y %H:%M", "%Y/%m/%d %H:%M:%S"]
    by_form = " ".join(f"WHEN {i} THEN strftime({ts}, '{f}')" for i, f in enumerate(forms))
    published = (f"CASE WHEN {m6} = 0 THEN CASE page_id // 6 % 8 {by_form} END "
                 f"WHEN {m6} = 1 AND page_id // 6 % 2 = 1 THEN strftime({ts}, '%Y%m%dT%H%M%SZ') "
                 f"WHEN {m6} = 1 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') "
                 f"WHEN {m6} = 2 THEN strftime({ts} + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+02:00' "
                 f"WHEN {m6} = 3 THEN 'not a date' WHEN {m6} = 5 THEN strftime({ts}, '%Y-%m-%d %H:%M:%S') END")
    pub_date = f"CASE WHEN {m6} = 3 THEN strftime({ts}, '%a, %d %b %Y %H:%M:%S') || ' GMT' END"
    updated = (f"CASE WHEN {m6} = 4 AND page_id % 4 <> 0 THEN strftime({ts}, '%Y-%m-%d') "
               f"WHEN {m6} = 4 THEN 'garbage' END")
    m11 = "page_id % 11"

    def tag(*terms):
        return "[" + ", ".join("{'term': " + ("CAST(NULL AS VARCHAR)" if t is None else q(t)) + "}"
                               for t in terms) + "]"
    tags = (f"CASE WHEN {m11} = 0 THEN {tag(' Top BM ', 'tech')} WHEN {m11} = 1 THEN {tag(' Tech ', 'science')} "
            f"WHEN {m11} = 2 THEN {tag('unknown', 'Venture Capital')} "
            f"WHEN {m11} = 3 THEN CAST([] AS STRUCT(term VARCHAR)[]) WHEN {m11} = 5 THEN {tag(None, 'F1')} "
            f"WHEN {m11} <> 4 THEN {tag('misc')} END")
    m7 = "page_id % 7"
    thumb = (f"CASE WHEN {m7} = 0 THEN [{{'url': 'https://img.example/t' || page_id || '.jpg'}}] "
             f"WHEN {m7} = 1 THEN [{{'url': CAST(NULL AS VARCHAR)}}] END")
    mc = (f"CASE WHEN {m7} = 2 THEN [{{'url': 'https://img.example/v.mp4', 'medium': 'video', 'type': 'video/mp4'}}, "
          f"{{'url': 'https://img.example/m' || page_id || '.jpg', 'medium': CAST(NULL AS VARCHAR), "
          f"'type': 'image/jpeg'}}] END")
    enc = (f"CASE WHEN {m7} = 3 THEN [{{'href': CAST(NULL AS VARCHAR), 'url': 'https://img.example/e' || page_id "
           f"|| '.gif', 'type': 'image/gif'}}] END")
    image = (f"CASE WHEN {m7} = 4 THEN {{'href': 'https://img.example/h' || page_id || '.png', "
             f"'url': CAST(NULL AS VARCHAR)}} END")
    content = (f"CASE WHEN page_id % 5 = 0 THEN [{{'value': {body}}}] WHEN page_id % 5 = 1 THEN "
               f"[{{'value': '<img src=\"//cdn.example/c' || page_id || '.png\">short'}}] END")
    return f"""SELECT CAST(page_id % 4 AS INTEGER) AS feed_ord, CAST(page_id // 4 AS BIGINT) AS entry_ord,
      CASE WHEN page_id % 13 = 0 THEN '  ' ELSE {title} END AS title,
      CASE WHEN page_id % 17 = 0 THEN '' WHEN page_id % 17 = 1 THEN ' ' || url || chr(10) ELSE url END AS link,
      {published} AS published, {pub_date} AS pubDate, {updated} AS updated, CAST(NULL AS VARCHAR) AS created,
      CASE WHEN page_id % 3 = 0 THEN {body} WHEN page_id % 3 = 1 THEN '   ' END AS summary,
      CASE WHEN page_id % 2 = 0 THEN '<p>' || {title} || '</p>' END AS description,
      {content} AS content, {tags} AS tags, {thumb} AS media_thumbnail, {mc} AS media_content,
      {enc} AS enclosures, {image} AS image FROM pages"""


def feed_sources_sql(extra=()) -> str:
    from .sources.dims import FEED_SOURCES
    rows = ", ".join(f"({i}, {q(n)}, {q(u)}, {q(c)}, {str(f).lower()}, {str(s).lower()})"
                     for i, (n, u, c, f, s) in enumerate(list(FEED_SOURCES) + list(extra)))
    return f"SELECT * FROM (VALUES {rows}) AS f(feed_ord, name, url, category, full_content_in_feed, is_sitemap)"


def normalized_sql(as_of: str = "TIMESTAMP '2024-02-01 00:00:00'") -> str:
    """CTE chain ending in ``arts`` (normalized feed articles) over ``raw_items_sql``."""
    from .sources.dims import CATEGORY_TERMS, EXCLUDED_TAG
    cat_map = "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in CATEGORY_TERMS.items()) + "}"
    s = strip("coalesce(summary, '')")
    d = strip("coalesce(description, '')")
    term = strip("coalesce(t.term, '')")
    c0 = "content[1].value"
    is_blank_ = lambda v: f"({v} IS NULL OR {strip(v)} = '')"
    cands = (f"list_concat(list_transform(list_filter(coalesce(content, CAST([] AS STRUCT(value VARCHAR)[])), "
             f"lambda c: NOT {is_blank_('c.value')}), lambda c: c.value), "
             f"[CASE WHEN NOT {is_blank_('summary')} THEN summary END], "
             f"[CASE WHEN NOT {is_blank_('description')} THEN description END])")
    from_html = (f"(list_filter(list_transform(list_filter({cands}, lambda h: h IS NOT NULL), "
                 f"lambda h: {html_image('h')}), lambda u: u IS NOT NULL))[1]")
    mc = ("list_filter(media_content, lambda m: m.medium = 'image' OR "
          "starts_with(coalesce(m.type, ''), 'image'))")
    en = "list_filter(enclosures, lambda e: starts_with(coalesce(e.type, ''), 'image'))"
    image = (f"CASE WHEN len(media_thumbnail) > 0 THEN media_thumbnail[1].url "
             f"WHEN len({mc}) > 0 THEN ({mc})[1].url "
             f"WHEN len({en}) > 0 THEN coalesce(nullif(({en})[1].href, ''), ({en})[1].url) "
             f"WHEN image IS NOT NULL THEN coalesce(nullif(image.href, ''), image.url) ELSE {from_html} END")
    cat_hit = (f"(list_filter(list_transform(tags, lambda t: {cat_map}[lower({term})]), "
               f"lambda c: c IS NOT NULL))[1]")
    excluded = (f"coalesce(list_bool_or(list_transform(tags, lambda t: lower({term}) = "
                f"{q(EXCLUDED_TAG)})), false)")
    full = (f"CASE WHEN full_content_in_feed THEN nullif(CASE WHEN length({s}) > 500 THEN {clean_html(s)} "
            f"WHEN length({d}) > 500 THEN {clean_html(d)} WHEN length(coalesce({c0}, '')) > 500 "
            f"THEN {clean_html(c0)} END, '') END")
    desc = (f"CASE WHEN {s} <> '' THEN left({clean_html(s)}, 500) WHEN {d} <> '' THEN left({clean_html(d)}, 500) "
            f"WHEN coalesce({c0}, '') <> '' THEN left({clean_html(c0)}, 500) END")
    # the instant each page's fixture date stands for, without parsing anything
    pid = "(entry_ord * 4 + feed_ord)"
    ts = f"(TIMESTAMP '2024-01-01 00:00:00' + {pid} * INTERVAL 1 HOUR)"
    date = (f"CASE WHEN {pid} % 6 = 0 AND {pid} // 6 % 8 = 2 THEN {ts} - INTERVAL 1 HOUR "
            f"WHEN {pid} % 6 = 4 AND {pid} % 4 <> 0 THEN date_trunc('day', {ts}) "
            f"WHEN {pid} % 6 = 4 THEN {as_of} ELSE {ts} END")
    title = strip("coalesce(title, '')")
    link = strip("coalesce(link, '')")
    return f"""raw AS ({raw_items_sql()}),
srcs AS ({feed_sources_sql()}),
j AS (SELECT c.*, s.name AS src_name, s.category AS src_cat, s.full_content_in_feed FROM raw c
      JOIN srcs s USING (feed_ord)),
arts AS (SELECT CAST(feed_ord AS BIGINT) * 1000000000 + entry_ord AS ord, {title} AS title, {link} AS link,
       src_name AS source, {date} AS published_at, {desc} AS description, {image} AS image,
       coalesce({cat_hit}, nullif(src_cat, ''), 'general') AS category, {full} AS content,
       ({full}) IS NOT NULL AS content_extracted
     FROM j WHERE NOT {excluded} AND {title} <> '' AND {link} <> '')"""
