import math
import re

import duckdb
import pytest

from conftest import SF001

import __spark_entry__ as E

TABLES = "events documents pages benchmark labels conversations".split()
SAMPLE = ["dedup_articles", "top_n_articles", "mention_extract", "company_mentions", "mention_fold",
          "entry_image", "date_parse", "aggregate_flow", "newest_first", "upsert_mentions", "stream_daily_metrics_late",
          "resolve_redirects", "content_attach", "upsert_articles", "daily_metrics", "summary_luhn", "banner_strip"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["pos", "ord", "published_at", "title", "source"]


def test_every_query_is_callable_and_most_have_oracles():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    own = [n for n in qs if not re.match(r"op\d+_|pipeline$", n)]
    assert len(own) >= 70 and len(set(sql) & set(own)) >= len(own) - 5


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


def _rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(x.item() if hasattr(x, "item") else x) for x in r)
                         for r in pdf[cols].itertuples(index=False)), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    s = _rows(E.queries()[name](spark, SF001).toPandas())
    o = _rows(con.execute(E.oracle_sql()[name]).df())
    assert s == o
