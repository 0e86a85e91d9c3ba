"""Block-based main text: density rules, host templates, awkward pages."""
from feedlens.operators import blocks

LONG = "this sentence has far more than ten words and so it is a long block of text number"


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, u, h, "clash") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, content_note string")
    out = blocks.main_blocks(df, **kw)
    assert out.columns == ["page_id", "url", "content_note", "content"]
    return {r.page_id: r.content for r in out.collect()}


def page(n, extra=""):
    return (f"<html><head><title>t</title></head><body><nav><a href='/'>Home</a> <a href='/x'>All the news of the day in one long list of links here</a></nav>"
            f"<div>Subscribe to our letter and get all the news of the day every morning by post {extra}</div>"
            f"<h2>Heading {n}</h2><p>{LONG} {n}</p><p>{LONG} b{n}</p><script>var a = '<p>{LONG}</p>';</script><footer>short</footer></body></html>")


def test_links_and_templates_go(spark):
    got = run(spark, [(f"https://a.example/{n}", page(n)) for n in range(4)] + [("https://b.example/1", page(9))])
    for n in range(4):
        assert got[n] == f"Heading {n}\n{LONG} {n}\n{LONG} b{n}\nshort".removesuffix("\nshort")
    letter = "Subscribe to our letter and get all the news of the day every morning by post"
    assert got[4].split("\n")[0] == letter          # one page of its host: nothing repeats there


def test_copies_of_a_page_keep_their_text(spark):
    got = run(spark, [("https://a.example/same", page(1))] * 6)
    assert all(LONG in t for t in got.values()) and len(set(got.values())) == 1
    alike = run(spark, [(f"https://a.example/{n}", f"<p>{LONG}</p>" + "<p>tail</p>" * (n > 3)) for n in range(2)])
    assert alike[0] == alike[1] == LONG


def test_a_page_of_templates_only_keeps_them(spark):
    rows = [(f"https://a.example/{n}", f"<p>{LONG}</p><p>{LONG} {n}</p>") for n in range(3)] + [("https://a.example/z", f"<p>{LONG}</p>")]
    got = run(spark, rows)
    assert got[3] == LONG and got[0] == f"{LONG} 0"


def test_awkward_pages(spark):
    rows = [("https://a/1", None), (None, ""), ("x", "<p> </p>"), ("https://a/2", "no tags at all but a long line of words that counts as a block of text"),
            ("https://a/3", f"<p>{LONG} &amp; &lt;b&gt;\u0001<a href=x>link</a></p><p>near</p><div>far <a>all of it linked text here</a></div>"),
            (None, f"<P CLASS='x'>{LONG}<BR>{LONG}</P>")]
    got = run(spark, rows)
    assert got[0] is None and got[1] is None and got[2] is None and got[3].startswith("no tags")
    assert got[4] == f"{LONG} & <b>link\nnear" and got[5] == LONG
    long = "<p>" + " ".join(f"word{i}" for i in range(300_000)) + "</p>"
    assert len(run(spark, [("https://a/9", long)])[0]) > 2_000_000
    assert run(spark, [("u", "x")] * 0 or [("https://e/", None)])[0] is None


def test_extraction_by_blocks(spark):
    from feedlens.operators.content import extract_pages
    rows = [(f"https://a.example/{n}", "<head><meta property='og:image' content='https://i/1'></head>" + page(n)) for n in range(3)]
    got = extract_pages(spark.createDataFrame(rows, "url string, html string"), by_blocks=True).orderBy("url").collect()
    assert [r.content for r in got] == [f"Heading {n}\n{LONG} {n}\n{LONG} b{n}" for n in range(3)]
