"""String and URL column expressions (all JVM-side, codegen friendly).

The patterns here are written so that the same text also runs under RE2 (DuckDB), which
is how the oracle SQL reproduces them: no look-around, no back-references, explicit
whitespace class instead of ``\\s``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, written out so Java and RE2 agree with it.
WS = (r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
WS_RUN = WS + "+"
# Scheme as urllib understands it.
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# The same set as a plain string, from the rule (Python's str.isspace; the largest
# whitespace code point is U+3000).
WS_CHARS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip_ws(c) -> Column:
    """Python ``str.strip()``: removes every Unicode whitespace, not only spaces.
    A character-set trim from both ends (no regex scan of the whole string)."""
    return F.trim(col_(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    """Python ``" ".join(s.split())``."""
    return strip_ws(F.regexp_replace(col_(c), WS_RUN, " "))


def is_blank(c) -> Column:
    """Null, empty or whitespace only. Looks for the first non-whitespace character
    (stops at once on ordinary text) instead of stripping the whole string."""
    return col_(c).isNull() | ~col_(c).rlike(WS.replace("[", "[^", 1))


def stripped_length_at_least(c, n: int) -> Column:
    """``length(strip(c)) >= n`` without stripping: a non-whitespace character, at
    least n-2 more characters, and a later non-whitespace character (n >= 2)."""
    nws = WS.replace("[", "[^", 1)
    return F.coalesce(col_(c).rlike(rf"(?s){nws}.{{{n - 2},}}{nws}"), F.lit(False))


def clean_html(c) -> Column:
    """Drop ``<...>`` tags, collapse whitespace, strip."""
    return collapse_ws(F.regexp_replace(col_(c), r"<[^>]+>", ""))


def normalize_url(c) -> Column:
    """Strip, lower, drop trailing slashes, then cut at '?', then at '#'."""
    u = F.lower(strip_ws(c))
    u = F.regexp_replace(u, r"/+\z", "")
    u = F.substring_index(u, "?", 1)
    return F.substring_index(u, "#", 1)


def normalize_title(c) -> Column:
    """Lower + whitespace collapse."""
    return collapse_ws(F.lower(col_(c)))


def fingerprint(c) -> Column:
    """D3: md5 hex of the URL key."""
    return F.md5(normalize_url(c))


def url_netloc(c) -> Column:
    """``urlparse(url).netloc``: authority after ``scheme://`` or a leading ``//``."""
    return F.regexp_extract(col_(c), rf"\A(?:{SCHEME}:)?//([^/?#]*)", 1)


def url_path(c) -> Column:
    """``urlparse(url).path``."""
    rest = F.regexp_replace(col_(c), rf"\A{SCHEME}:", "")
    rest = F.regexp_replace(rest, r"\A//[^/?#]*", "")
    return F.regexp_extract(rest, r"\A([^?#]*)", 1)


def url_domain(c) -> Column:
    """Netloc (port and case kept), else first path segment."""
    net = url_netloc(c)
    return F.when(net != "", net).otherwise(F.substring_index(url_path(c), "/", 1))


def url_has_lang_prefix(c) -> Column:
    """First segment of the stripped path is exactly two letters."""
    seg = F.substring_index(F.regexp_replace(url_path(c), r"\A/+|/+\z", ""), "/", 1)
    return seg.rlike(r"\A\p{L}{2}\z")


def route_host(c) -> Column:
    """N15 host form: lower netloc without a leading ``www.``."""
    return F.regexp_replace(F.lower(url_netloc(c)), r"\Awww\.", "")


def host_matches_any(c, domains) -> Column:
    """Host equals d or ends with '.d' for any listed d."""
    h = route_host(c)
    cond = F.lit(False)
    for d in domains:
        cond = cond | (h == d) | h.endswith("." + d)
    return cond


def text_fallback(content, description, title=None) -> Column:
    """First of content/description(/title) that is neither null nor empty."""
    parts = [F.nullif(col_(content), F.lit("")), F.nullif(col_(description), F.lit(""))]
    if title is not None:
        parts.append(col_(title))
    return F.coalesce(*parts)


def split_words(c) -> Column:
    """Python ``str.split()`` as an array (no empty tokens)."""
    return F.filter(F.split(col_(c), WS_RUN), lambda w: w != "")


def word_count(c) -> Column:
    return F.size(split_words(c))


def truncate_words(c, n: int) -> Column:
    """First n words + '...', unchanged when it has n words or fewer."""
    w = split_words(c)
    return F.when(F.size(w) <= n, col_(c)).otherwise(
        F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("...")))


def host_of(c) -> Column:
    """Host without port (used to name a page's source)."""
    return F.regexp_extract(col_(c), rf"\A{SCHEME}://([^/?#:]*)", 1)
