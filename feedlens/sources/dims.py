"""Dimension tables: feed sources, category dictionary, company aliases, companies.

All of them are small, fixed-size and broadcast; their contents must equal the
service we mirror for results to agree, so they are stated once, here, as data.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values (must equal the mirrored service) ---------------------------------

# Tag term (lowercase) -> category.
CATEGORY_TERMS: dict[str, str] = {
    "tech": "technology", "technology": "technology", "gadgets": "technology",
    "software": "technology", "hardware": "technology", "apps": "technology",
    "ai": "technology", "artificial intelligence": "technology",
    "cybersecurity": "technology", "security": "technology",
    "mobile": "technology", "smartphones": "technology", "computing": "technology",
    "internet": "technology", "it": "technology", "programming": "technology",
    "developer": "technology", "cloud": "technology", "robotics": "technology",
    "tech policy": "technology",
    "science": "science", "space": "science", "environment": "science",
    "health": "science", "medicine": "science", "biology": "science",
    "physics": "science", "climate": "science", "research": "science",
    "culture": "culture", "entertainment": "culture", "gaming": "culture",
    "games": "culture", "movies": "culture", "music": "culture",
    "food": "culture", "arts": "culture",
    "tv": "culture", "streaming": "culture", "social media": "culture",
    "features": "culture",
    "lifestyle": "lifestyle", "leisure": "lifestyle", "opinion": "lifestyle",
    "travel": "lifestyle", "wellness": "lifestyle",
    "business": "business", "finance": "business", "economy": "business",
    "markets": "business", "startups": "business", "venture capital": "business",
    "cryptocurrency": "business", "crypto": "business", "energy": "business",
    "politics": "politics", "policy": "politics", "government": "politics",
    "law": "politics", "nation": "politics", "election": "politics",
    "world": "world", "international": "world",
    "sports": "sports", "football": "sports", "soccer": "sports",
    "basketball": "sports", "tennis": "sports", "f1": "sports",
    "cars": "cars", "automotive": "cars", "ev": "cars",
    "electric vehicles": "cars", "transportation": "cars",
}

# Alias (lowercase) -> (company name, ticker), in dictionary order.
COMPANY_ALIASES: list[tuple[str, str, str]] = [
    ("apple", "Apple", "AAPL"),
    ("apple inc", "Apple", "AAPL"),
    ("apple inc.", "Apple", "AAPL"),
    ("aapl", "Apple", "AAPL"),
    ("microsoft", "Microsoft", "MSFT"),
    ("microsoft corp", "Microsoft", "MSFT"),
    ("microsoft corporation", "Microsoft", "MSFT"),
    ("msft", "Microsoft", "MSFT"),
    ("google", "Google", "GOOGL"),
    ("alphabet", "Google", "GOOGL"),
    ("alphabet inc", "Google", "GOOGL"),
    ("alphabet inc.", "Google", "GOOGL"),
    ("googl", "Google", "GOOGL"),
    ("goog", "Google", "GOOGL"),
    ("amazon", "Amazon", "AMZN"),
    ("amazon.com", "Amazon", "AMZN"),
    ("amazon inc", "Amazon", "AMZN"),
    ("amzn", "Amazon", "AMZN"),
    ("aws", "Amazon", "AMZN"),
    ("amazon web services", "Amazon", "AMZN"),
    ("meta", "Meta", "META"),
    ("meta platforms", "Meta", "META"),
    ("meta platforms inc", "Meta", "META"),
    ("facebook", "Meta", "META"),
    ("tesla", "Tesla", "TSLA"),
    ("tesla inc", "Tesla", "TSLA"),
    ("tesla motors", "Tesla", "TSLA"),
    ("tsla", "Tesla", "TSLA"),
    ("nvidia", "Nvidia", "NVDA"),
    ("nvidia corp", "Nvidia", "NVDA"),
    ("nvidia corporation", "Nvidia", "NVDA"),
    ("nvda", "Nvidia", "NVDA"),
]

# Aliases left out of the regex path (common English words).
AMBIGUOUS_ALIASES = ("apple", "meta", "facebook")

# Companies table seed: (name, ticker, icon_url), in seed order.
COMPANIES: list[tuple[str, str, str]] = [
    ("Apple", "AAPL", "https://logo.clearbit.com/apple.com"),
    ("Microsoft", "MSFT", "https://logo.clearbit.com/microsoft.com"),
    ("Google", "GOOGL", "https://logo.clearbit.com/google.com"),
    ("Amazon", "AMZN", "https://logo.clearbit.com/amazon.com"),
    ("Meta", "META", "https://logo.clearbit.com/meta.com"),
    ("Tesla", "TSLA", "https://logo.clearbit.com/tesla.com"),
    ("Nvidia", "NVDA", "https://logo.clearbit.com/nvidia.com"),
]

# Configured feeds: (name, url, category, full_content_in_feed, is_sitemap), in order.
FEED_SOURCES: list[tuple[str, str, str, bool, bool]] = [
    ("Ars Technica", "https://feeds.arstechnica.com/arstechnica/index", "technology", False, False),
    ("Wired Culture", "https://www.wired.com/feed/category/culture/latest/rss", "culture", False, False),
    ("Fast Company", "https://www.fastcompany.com/latest/rss", "technology", True, False),
    ("The Edge Malaysia",
     "https://news.google.com/rss/search?q=https%3A%2F%2Ftheedgemalaysia.com%2F&hl=en-MY&gl=MY&ceid=MY%3Aen",
     "general", False, False),
    ("Free Malaysia Today", "https://cms.freemalaysiatoday.com/feed", "general", True, False),
    ("The Verge", "https://www.theverge.com/rss/index.xml", "technology", False, False),
    ("Fortune", "https://fortune.com/feed/fortune-feeds/?id=3230629", "business", True, False),
    ("NYTimes Technology", "https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml", "technology", False, False),
    ("CNBC", "https://search.cnbc.com/rs/search/combinedcms/view.xml?partnerId=wrss01&id=100003114", "news", False, False),
    ("The Atlantic", "https://www.theatlantic.com/feed/all/", "news", True, False),
]

# Consent/cookie banner keywords (substring match on the lowered, stripped line).
BANNER_KEYWORDS = (
    "cookie", "consent", "tracking", "privacy", "gdpr",
    "advertising", "analytics", "opt out", "opt-out",
    "social media", "essential", "third party", "third-party",
    "manage preferences", "your choices", "do not sell",
    "these cookies", "this website uses", "audience measurement",
    "measurement cookies", "traffic sources", "performance statistics",
    "functioning of the site", "browsing experience",
)

# Domains routed to a browser fetch (suffix match).
BROWSER_REQUIRED_DOMAINS = ("reuters.com", "arstechnica.com")

# Tag whose presence drops an entry.
EXCLUDED_TAG = "top bm"

AGGREGATOR_HOST = "news.google.com"  # links there are decoded to the article's own URL

# Numeric defaults.
MAX_ARTICLES_PER_FEED = 50
MAX_TOTAL_ARTICLES = 200
CACHE_TTL_SECONDS = 300
EXTRACTION_BATCH = 60
NEW_SOURCE_RELIABILITY = 0.5
MENTION_REGEX_CONFIDENCE = 0.9
MENTION_MODEL_CONFIDENCE = 0.8
CONTEXT_MAX_CHARS = 500
MODEL_TEXT_MAX_CHARS = 10000
NEUTRAL_FIN = ("neutral", 0.5, 0.33, 0.33, 0.34)  # label, score, pos, neg, neu

# -------------------------------------------------------------------------------------

FEED_SOURCE_SCHEMA = T.StructType([
    T.StructField("feed_ord", T.IntegerType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("category", T.StringType(), True),
    T.StructField("full_content_in_feed", T.BooleanType(), False),
    T.StructField("is_sitemap", T.BooleanType(), False),
])


def feed_sources(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """The feed source dimension; ``extra`` appends sources after the configured ones."""
    rows = [(i, *r) for i, r in enumerate(FEED_SOURCES + list(extra or []))]
    return spark.createDataFrame(rows, FEED_SOURCE_SCHEMA)


def add_feed_source(sources: DataFrame, name: str, url: str, category: str | None = None,
                    full_content_in_feed: bool = False, is_sitemap: bool = False) -> DataFrame:
    """Append one source at the next position."""
    nxt = sources.agg(F.coalesce(F.max("feed_ord") + 1, F.lit(0)).alias("feed_ord"))
    new = nxt.select(F.col("feed_ord").cast("int"), F.lit(name).alias("name"), F.lit(url).alias("url"),
                     F.lit(category).cast("string").alias("category"),
                     F.lit(full_content_in_feed).alias("full_content_in_feed"),
                     F.lit(is_sitemap).alias("is_sitemap"))
    return sources.unionByName(new)


def category_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(CATEGORY_TERMS.items()), "term string, category string")


def category_map_expr():
    """The dictionary as a map literal (74 entries) for per-row lookups."""
    kv = []
    for k, v in CATEGORY_TERMS.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def company_aliases(spark: SparkSession) -> DataFrame:
    rows = [(a, n, t, i, a in AMBIGUOUS_ALIASES) for i, (a, n, t) in enumerate(COMPANY_ALIASES)]
    return spark.createDataFrame(
        rows, "alias string, name string, ticker string, ord int, ambiguous boolean")


def companies(spark: SparkSession) -> DataFrame:
    """Seeded companies with surrogate ids in seed order (1-based)."""
    rows = [(i + 1, n, t, u) for i, (n, t, u) in enumerate(COMPANIES)]
    return spark.createDataFrame(rows, "id long, name string, ticker string, icon_url string")


def alias_map_expr():
    """alias -> struct(name, ticker) map literal."""
    kv = []
    for a, n, t in COMPANY_ALIASES:
        kv += [F.lit(a), F.struct(F.lit(n).alias("name"), F.lit(t).alias("ticker"))]
    return F.create_map(*kv)


def regex_aliases() -> list[str]:
    """Aliases used by the regex path: longest escaped form first, stable on ties.

    The ordering key is the length of Python's ``re.escape`` form (spaces and dots are
    escaped there), which decides which alternative wins at a position.
    """
    keep = [a for a, _, _ in COMPANY_ALIASES if a not in AMBIGUOUS_ALIASES]
    return sorted(keep, key=lambda a: len(re.escape(a)), reverse=True)


def alias_pattern() -> str:
    """``\\b(alt|alt|...)\\b`` valid in both Java regex and RE2 (only '.' needs escaping)."""
    alts = [a.replace(".", "\\.") for a in regex_aliases()]
    return "\\b(" + "|".join(alts) + ")\\b"


def _trie(words: list[str]) -> str:
    """Regex for a set of literal words as a character trie; at every branch point
    longer continuations are optional groups tried before stopping, so the first
    match at a position is the longest word that also passes the trailing check —
    the same match a longest-first alternation gives, with far fewer alternatives
    tried per position."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        branches = [(re.escape(ch).replace("\\ ", " ")) + emit(node[ch]) for ch in sorted(k for k in node if k)]
        if not branches:
            return ""
        if len(branches) == 1 and not end:
            return branches[0]
        return "(?:" + "|".join(branches) + ")" + ("?" if end else "")

    return emit(root)


def alias_trie_pattern() -> str:
    """``\\b(trie)\\b`` over the regex-path aliases (Java regex)."""
    return "\\b(" + _trie(regex_aliases()) + ")\\b"
