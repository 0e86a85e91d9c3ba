from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedlens.operators import normalize as NZ
from feedlens.sources import dims
from feedlens.sources import feeds as FD

RSS = """<?xml version="1.0"?>
<rss version="2.0" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel><title>T</title>
<item><title> First </title><link>https://ex.com/a/</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate>
<description>&lt;p&gt;Hello &lt;b&gt;world&lt;/b&gt;&lt;/p&gt;</description><category>Tech</category>
<media:thumbnail url="https://img/1.jpg"/></item>
<item><title>Second</title><link>https://ex.com/b</link><pubDate>garbage</pubDate><category>Top BM</category></item>
<item><title></title><link>https://ex.com/c</link></item>
<item><title>Fourth</title><link>https://ex.com/d</link><pubDate>2024-01-02T03:04:05Z</pubDate>
<category>unknown</category><category>Venture Capital</category>
<enclosure url="https://img/e.gif" type="image/gif"/></item>
</channel></rss>"""

SITEMAP = """<?xml version="1.0"?>
<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"
 xmlns:image="http://www.google.com/schemas/sitemap-image/1.1">
<url><loc>https://r.com/world/x</loc><news:news><news:title> Big </news:title>
<news:publication_date>2024-01-05T00:00:00Z</news:publication_date></news:news>
<image:image><image:loc>https://r.com/i.jpg</image:loc></image:image></url>
<url><loc>https://r.com/es/y</loc><news:news><news:title>ES</news:title></news:news></url>
<url><loc>https://r.com/z</loc><news:news><news:title></news:title></news:news></url>
</urlset>"""

AS_OF = datetime(2024, 2, 1)


def test_rss_scan_and_normalize(spark, tmp_path):
    (tmp_path / "feed0.xml").write_text(RSS)
    raw = FD.read_rss(spark, str(tmp_path / "feed0.xml"))
    assert raw.count() == 4
    arts = NZ.normalize_entries(raw, dims.feed_sources(spark), AS_OF).orderBy("ord").collect()
    assert [a.title for a in arts] == ["First", "Fourth"]
    first, fourth = arts
    assert first.published_at == datetime(2024, 1, 1, 8, 0)
    assert first.description == "Hello world" and first.category == "technology"
    assert first.image == "https://img/1.jpg" and first.source == "Ars Technica"
    assert fourth.published_at == datetime(2024, 1, 2, 3, 4, 5)
    assert fourth.category == "business" and fourth.image == "https://img/e.gif"


def test_sitemap_scan_and_normalize(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SITEMAP)
    items = FD.read_sitemap(spark, str(tmp_path / "s.xml"), feed_ord=10)
    srcs = dims.add_feed_source(dims.feed_sources(spark), "Reuters", "https://r.com/sitemap", "news",
                                is_sitemap=True)
    out = NZ.normalize_sitemap(items, srcs, AS_OF).collect()
    assert [(r.title, r.link, r.image, r.category) for r in out] == [("Big", "https://r.com/world/x",
                                                                        "https://r.com/i.jpg", "news")]
    assert out[0].published_at == datetime(2024, 1, 5)


def test_date_formats(spark):
    cases = {
        "Tue, 02 Jan 2024 03:00:00 GMT": datetime(2024, 1, 2, 3), "02 Jan 2024 03:00:00 -0100": datetime(2024, 1, 2, 4),
        "2024-01-02T05:00:00+02:00": datetime(2024, 1, 2, 3), "2024-01-02": datetime(2024, 1, 2), "nope": None, None: None,
        "Tue, 02 Jan 2024 03:00:00 EST": datetime(2024, 1, 2, 3), "Tue, 02 Jan 2024 03:00 +0100": datetime(2024, 1, 2, 2),
        "Tuesday, 02 January 2024 03:00:00 GMT": datetime(2024, 1, 2, 3), "Tue, 02 Jan 24 03:00:00 +0000": datetime(2024, 1, 2, 3),
        "Tue, 02 Jan 2024 03:00:00 +05:30": datetime(2024, 1, 1, 21, 30), "Jan 2, 2024 03:00": datetime(2024, 1, 2, 3),
        "2024/01/02 03:00:00": datetime(2024, 1, 2, 3), "20240102T030000Z": datetime(2024, 1, 2, 3),
        " 2024-01-02 03:04:05.678 ": datetime(2024, 1, 2, 3, 4, 5, 678000), "2 Sept 1999 23:59:59 Z": datetime(1999, 9, 2, 23, 59, 59),
        "31 Feb 2024 00:00:00 GMT": None, "02 Foo 2024 03:00:00 GMT": None, "Mon, 5 Feb 74 01:02:03 UT": datetime(1974, 2, 5, 1, 2, 3),
        "": None, "2024-13-02": None, "December 31, 2023": datetime(2023, 12, 31),
    }
    df = spark.createDataFrame([(i, d) for i, d in enumerate(cases)], "i int, d string")
    got = [r[1] for r in sorted(df.select("i", NZ.parse_date("d")).collect())]
    assert got == list(cases.values())


FORMS = """2024-03-04T05:06:07Z|2024-03-04 05:06|20240304|20240304T050607|20240304T0506|2024/3/4|2024.03.04|4 Mar 2024|Mar 4 2024|March 4, 2024
4 March 2024 10pm|Mon, 04 Mar 2024 05:06:07 +0200|Monday, 4 March 2024 05:06:07|10:00 4 Mar 2024|10:00 AM Mar 4 2024|03/04/2024|3/4/2024 5:06 pm
14/03/2024|31.12.2023|12-31-2023|2024 Mar 4|2024-Mar-04|04-Mar-2024|Mar-2024-04|Thu Mar 14 05:06:07 2024|Thu Mar 14 05:06:07 EST 2024|14th of March 2024
March 14th, 2024 at 3:04pm|2024-03-04T05:06:07.123456+05:30|2024-03-04 05:06:07,123|12:00 am 4 Mar 2024|12:30 pm 4 Mar 2024|4 Mar 2024 05:06:07 -0130
4 Mar 2024 05:06 GMT|Mar 2024|March 2023 10:00|10:30|4 March|2024|Feb 2024|20240304050607|99-Feb-01|3/14/2024 05:06:07|2024-03-04T05:06:07-08
2024-03-04T05:06:07+0100|Wednesday 6th March 2024|6 Sept 2023|Tue, 5 Mar 2024 1:02:03"""
BROKEN = """yesterday|not a date|2024-13-02|31 Feb 2024|32/13/2024|Foo 4 2024|25:00 4 Mar 2024|13:00 pm 4 Mar 2024|1 2 3 4|Mar Apr 2024|4 Mar 2024 @ noon|12345|::|--|Mar 4 2024 10:61"""


def test_dates_as_a_general_parser_reads_them(spark):
    """Forms that dateutil reads, with what is left out taken from a default; and what neither reads."""
    import pytest
    dateutil = pytest.importorskip("dateutil.parser")
    default = datetime(2024, 5, 31)
    forms = [f for line in FORMS.split("\n") for f in line.split("|")]
    assert len(forms) >= 45

    def want(text):
        try:
            at = dateutil.parse(text, default=default, tzinfos=lambda name, offset: offset or 0)
        except (ValueError, OverflowError):
            return None
        return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    rows = [*forms, *BROKEN.split("|")]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(rows)], "i int, d string")
    got = [r[1] for r in sorted(df.select("i", NZ.parse_date("d", default)).collect())]
    assert [(f, g) for f, g in zip(rows, got)] == [(f, want(f)) for f in rows]
    assert all(g is not None for g in got[:len(forms)]) and not any(got[len(forms):])
    bare = {r.d: r.t for r in df.select("d", NZ.parse_date("d").alias("t")).collect()}
    assert bare["Mar 2024"] is None and bare["10:30"] is None and bare["4 Mar 2024"] == datetime(2024, 3, 4)


def test_unreadable_fields_move_on(spark):
    df = spark.createDataFrame([("soon", "3/14/2024 5 pm", None, None), ("", None, "Foo", "2024"), (None, None, None, None)], "a string, b string, c string, d string")
    as_of = datetime(2024, 2, 1)
    got = [r[0] for r in df.select(NZ.entry_date("a", "b", "c", "d", as_of)).collect()]
    assert got == [datetime(2024, 3, 14, 17), datetime(2024, 2, 1), as_of]


ATOM = """<?xml version="1.0"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://search.yahoo.com/mrss/"><title>T</title>
<entry><title type="html">One</title><link rel="self" href="https://a.com/self"/><link href="https://a.com/1"/>
<published>2024-01-03T04:00:00Z</published><updated>2024-01-09T04:00:00Z</updated>
<summary type="html">&lt;b&gt;Short&lt;/b&gt; text</summary><category term="Tech"/>
<link rel="enclosure" href="https://img/x.png" type="image/png"/></entry>
<entry><title>Two</title><link rel="alternate" href="https://a.com/2"/><updated>2024-01-04T00:00:00+01:00</updated>
<content type="html">&lt;p&gt;Body&lt;/p&gt;</content></entry>
</feed>"""


def test_atom_scan_and_normalize(spark, tmp_path):
    (tmp_path / "feed0.xml").write_text(ATOM)
    raw = FD.read_atom(spark, str(tmp_path / "feed0.xml"))
    one, two = NZ.normalize_entries(raw, dims.feed_sources(spark), AS_OF).orderBy("ord").collect()
    assert (one.title, one.link, one.description, one.category, one.image) == (
        "One", "https://a.com/1", "Short text", "technology", "https://img/x.png")
    assert one.published_at == datetime(2024, 1, 3, 4) and two.published_at == datetime(2024, 1, 3, 23)
    assert (two.title, two.link, two.description) == ("Two", "https://a.com/2", "Body")


def test_positions_over_many_blocks(spark, tmp_path):
    items = "".join(f"<item><title>t{i}</title><link>https://x/{i}</link></item>\n" for i in range(3000))
    (tmp_path / "feed0.xml").write_text(f"<rss><channel>{items}</channel></rss>")
    (tmp_path / "feed1.xml").write_text("<rss><channel><item><title>u0</title><link>l</link></item></channel></rss>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = FD.read_rss(spark, f"{tmp_path}/*.xml")
        got = sorted((r.feed_ord, r.entry_ord, r.title) for r in raw.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(0, i, f"t{i}") for i in range(3000)] + [(1, 0, "u0")]


def test_first_sitemap_image(spark, tmp_path):
    (tmp_path / "s.xml").write_text(SITEMAP.replace("</image:image></url>", "</image:image><image:image>"
                                                    "<image:loc>https://r.com/second.jpg</image:loc></image:image></url>"))
    got = FD.read_sitemap(spark, str(tmp_path / "s.xml"), feed_ord=10).orderBy("entry_ord").first()
    assert got.image_loc == "https://r.com/i.jpg"


def test_entries_are_capped_only_on_request(spark):
    rows = [(0, i, f"t{i}", f"https://x/{i}") for i in range(60)]
    df = FD.raw_items_from_pages(spark, "/root/testdata/sf0.001").limit(0)
    have = spark.createDataFrame(rows, "feed_ord int, entry_ord long, title string, link string")
    df = df.unionByName(have, allowMissingColumns=True)
    srcs = dims.feed_sources(spark)
    assert NZ.normalize_entries(df, srcs, AS_OF).count() == 60
    assert NZ.normalize_entries(df, srcs, AS_OF, per_feed=50).count() == 50


def test_feed_cap_before_validation(spark):
    rows = [(0, i, "" if i % 2 else f"t{i}", f"https://x/{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "feed_ord int, entry_ord long, title string, link string")
    assert NZ.cap_per_feed(df).count() == 50
    assert NZ.cap_per_feed(df).where(F.col("title") != "").count() == 25


def test_redirects(spark):
    a = spark.createDataFrame([(1, "https://news.google.com/x", "G"), (2, "https://y", "G"), (3, "https://news.google.com/x", "Z"),
                               (4, "https://news.google.com/none", "G")], "ord long, link string, source string")
    m = spark.createDataFrame([(5, "https://news.google.com/x", "https://late"), (4, "https://news.google.com/x", "https://real/x"),
                               (1, "https://y", "https://never"), (1, "https://news.google.com/none", "")],
                              "ord long, link string, decoded_url string")
    srcs = dims.add_feed_source(dims.feed_sources(spark).limit(0), "G", "https://news.google.com/rss")
    got = sorted((r.ord, r.link) for r in NZ.resolve_redirects(a, m, srcs).collect())
    assert got == [(1, "https://real/x"), (2, "https://y"), (3, "https://news.google.com/x"), (4, "https://news.google.com/none")]


RDF = """<?xml version="1.0"?><rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title><items/></channel>
<item rdf:about="a"><title>One &amp; only</title><link>https://r/1</link><dc:date>2024-01-02T03:04:05+01:00</dc:date><dc:subject>Tech</dc:subject><dc:subject>x</dc:subject>
<image> https://img/plain.png </image></item>
<item><title><![CDATA[Two </b> <item]]></title><link>https://r/2</link><dcterms:issued>2024-01-03</dcterms:issued><image><url>https://img/child.png</url></image></item>
<item><title>Three</title><link>https://r/3</link><itunes:image href="https://img/attr.png"/><category>Science</category></item>
<item><title>broken<link>https://r/4</link></item>
<entry><title type="html">Four</title><link href="https://r/5"/><issued>2024-01-04T00:00:00Z</issued><modified>2024-01-05T00:00:00Z</modified></entry></rdf:RDF>"""


def test_rss_one_dublin_core_and_images(spark, tmp_path):
    (tmp_path / "feed3.xml").write_text(RDF)
    (tmp_path / "feed4.xml").write_text("<rss></rss>")
    files = spark.read.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_path AS _file").distinct().withColumn("feed_ord", F.lit(3))
    got = {r.link: r for r in FD.read_feeds(spark, str(tmp_path), files).where("link is not null").collect()}
    assert {k: got[k].title for k in got} == {"https://r/1": "One & only", "https://r/2": "Two </b> <item", "https://r/3": "Three", "https://r/5": "Four"}
    assert [got[f"https://r/{k}"].entry_ord for k in (1, 2, 3, 5)] == [0, 1, 2, 4]
    one = got["https://r/1"]
    assert one.updated == "2024-01-02T03:04:05+01:00" and [t.term for t in one.tags] == ["Tech", "x"] and (one.image.href, one.image.url) == (None, "https://img/plain.png")
    assert got["https://r/2"].published == "2024-01-03" and got["https://r/2"].image.url == "https://img/child.png"
    assert got["https://r/3"].image.href == "https://img/attr.png" and [t.term for t in got["https://r/3"].tags] == ["Science"]
    assert got["https://r/5"].published == "2024-01-04T00:00:00Z" and got["https://r/5"].updated == "2024-01-05T00:00:00Z" and got["https://r/5"].image is None
    arts = NZ.normalize_entries(FD.read_feeds(spark, str(tmp_path), files), dims.feed_sources(spark), datetime(2024, 2, 1))
    at = {r.link: (r.published_at, r.image) for r in arts.collect()}
    assert at["https://r/1"] == (datetime(2024, 1, 2, 2, 4, 5), "https://img/plain.png") and at["https://r/2"][0] == datetime(2024, 1, 3)
    batch = {r.link: r for r in FD.read_rss(spark, str(tmp_path / "feed3.xml"), files).where("link is not null").collect()}
    assert batch["https://r/1"].updated == one.updated and batch["https://r/3"].image.href == "https://img/attr.png"


def test_a_backlog_of_feeds_comes_in_bounded_batches(spark, tmp_path):
    from feedlens.streaming.ingest import feed_stream
    (tmp_path / "in").mkdir()
    for n in range(7):
        (tmp_path / "in" / f"f{n}.xml").write_text(f"<rss><item><title>t{n}</title><link>https://x/{n}</link></item></rss>")
    seen = []
    q = (feed_stream(spark, str(tmp_path / "in"), files_per_trigger=3).writeStream.trigger(availableNow=True)
         .foreachBatch(lambda df, e: seen.append(sorted(r.link for r in df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).start())
    q.awaitTermination()
    assert [len(b) for b in seen] == [3, 3, 1] and sorted(x for b in seen for x in b) == [f"https://x/{n}" for n in range(7)]
