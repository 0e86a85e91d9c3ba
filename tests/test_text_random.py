"""Randomized checks of the column expressions against the plain-Python rules."""
import random
import re

from feedlens.functions import text as X
from feedlens.sources import dims

ALPH = ["a", "B", "/", "?", "#", ".", ":", " ", "\t", "\n", " ", " ", "\x1c", "é", "x", "-", "=", "&"]


def _rand_url(rnd):
    scheme = rnd.choice(["https://", "HTTP://", "//", "", "ftp://", "mailto:"])
    host = rnd.choice(["Ex.com", "www.reuters.com", "a.arstechnica.com:8080", "", "sub.EX.org"])
    path = "".join(rnd.choice(ALPH) for _ in range(rnd.randint(0, 12)))
    pad = rnd.choice(["", " ", "\n\t", "　"])
    return pad + scheme + host + path + pad


def test_url_keys_of_random_urls(spark):
    """A key is lower case, has neither query nor fragment nor outer white space, is a prefix of
    the lowered URL, and keying it again changes nothing but a slash bared by the cut."""
    rnd = random.Random(5)
    df = spark.createDataFrame([(_rand_url(rnd),) for _ in range(400)], "u string")
    for u, k, again in df.select("u", X.normalize_url("u").alias("k"), X.normalize_url(X.normalize_url("u")).alias("a")).collect():
        assert k == k.lower() and not set("?#") & set(k) and u.strip().lower().startswith(k), u
        assert again == k.strip().rstrip("/"), u


URLS = {  # url: (key, domain, must be read through a browser)
    "https://Ex.com/A?b#c": ("https://ex.com/a", "Ex.com", False),
    "https://ex.com/a//": ("https://ex.com/a", "ex.com", False),
    "https://www.reuters.com/x/?y": ("https://www.reuters.com/x/", "www.reuters.com", True),
    "HTTP://a.ARStechnica.com/": ("http://a.arstechnica.com", "a.ARStechnica.com", True),
    "https://a.arstechnica.com:8080/p": ("https://a.arstechnica.com:8080/p", "a.arstechnica.com:8080", False),
    "https://notreuters.com": ("https://notreuters.com", "notreuters.com", False),
    "//cdn.ex.org/p#q?r": ("//cdn.ex.org/p", "cdn.ex.org", False),
    "ex.com/path/x": ("ex.com/path/x", "ex.com", False),
    "https://reuters.com.evil.org/": ("https://reuters.com.evil.org", "reuters.com.evil.org", False),
}


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "u string")
    got = df.select("u", X.normalize_url("u"), X.url_domain("u"), X.host_matches_any("u", dims.BROWSER_REQUIRED_DOMAINS)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == URLS


def test_title_clean_truncate_match_python(spark):
    rnd = random.Random(9)
    words = ["Big", "news", "<b>", "</b>", "<p class='x'>", " ", " ", "\x1f", "é", "  ", "\t", "a<b"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 15))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", X.normalize_title("t").alias("n"), X.clean_html("t").alias("c"),
                    X.truncate_words("t", 4).alias("w"), X.word_count("t").alias("wc")).collect()
    for r in got:
        assert r.n == " ".join(r.t.lower().split())
        assert r.c == " ".join(re.sub(r"<[^>]+>", "", r.t).split()).strip()
        ws = r.t.split()
        assert r.w == (r.t if len(ws) <= 4 else " ".join(ws[:4]) + "...")
        assert r.wc == len(ws)
