import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from feedlens.session import build_session
    s = build_session(master="local[*]", app="feedlens-tests", shuffle_partitions=8)
    yield s
    s.stop()


def rows(df, *cols):
    cols = cols or df.columns
    return [tuple(r[c] for c in cols) for r in df.collect()]


ART_SCHEMA = ("ord long, title string, link string, source string, published_at timestamp, "
              "description string, image string, category string, content string, content_extracted boolean")


def make_articles(spark, specs):
    """specs: (ord, title, link, source[, published_at])"""
    from datetime import datetime
    out = []
    for s in specs:
        ts = s[4] if len(s) > 4 else datetime(2024, 1, 1)
        out.append((s[0], s[1], s[2], s[3], ts, None, None, None, None, False))
    return spark.createDataFrame(out, ART_SCHEMA)
