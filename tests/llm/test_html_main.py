from tidewright.llm import html_main

PAGES = "page_id long, url string, html string"
FURNISHED = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body>
<header class=top>Site</header><nav><ul><li>Menu<li>More</ul></nav><div class="ad">Buy</div>
<!-- note --><article><h1>Head &amp; shoulders</h1><p><b>One<br>two<p>Three&nbsp;<i>four</i>five
<aside>Aside</aside><form><p>Your mail</p></form><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>
<script>var t="</p>";</script><div class="comments"><p>Nice!</p></div><div id="cookie-notice">Accept</div></article>
<div class="sidebar">Side</div><footer>&copy; me</footer></body></html>"""


def test_article_without_furniture():
    assert html_main.main_text(FURNISHED, set()) == "Head & shoulders One two Three fourfive a b x y"


def test_odd_pages():
    for page, want in (
        (None, ""),
        ("", ""),
        ("plain & text", "plain & text"),
        ("<p>a<p>b", "a b"),
        ("<article><p>a</p>", "a"),
        ("<article><p>a <b>b</article><footer>f", "a b"),
        ("<main><p>m</p></main><p>n</p>", "m"),
        ("<div><p>a</div><p>b", "a b"),
        ("<p title='x > y'>q</p>", "q"),
        ("<p>a &lt;b&gt; &#233; &nosuch; &amp;amp;</p>", "a <b> é &nosuch; &amp;"),
        ("<script>never ended <p>x</p>", ""),
        ("<article>" * 300 + "deep", "deep"),
        ("a < b and c <3", "a < b and c <3"),
        ("<!-- open <p>x", ""),
        ("<textarea><p>x</p></textarea>y", "y"),
        ("<p>" + "w " * 200_000 + "</p>", " ".join(["w"] * 200_000)),
    ):
        assert html_main.main_text(page, set()) == want, page and page[:80]


def test_templates_are_found_by_host(spark):
    page = lambda k: f"<body><div><span>Welcome to our site</span></div><section><p>Story {k} is told here</p></section><div>Bottom line</div></body>"
    rows = [(k, f"http://a.example/{k}?q", page(k)) for k in range(8)] + [(100, "https://user@B.example:8080/x", page(1)), (101, None, page(2)), (102, "nonsense", None), (0, "http://a.example/0", page(0))]
    df = spark.createDataFrame(rows, PAGES)
    got = {(r["page_id"], r["url"]): r["text"] for r in html_main.extract(df).collect()}
    assert len(got) == len(rows)
    assert all(got[(k, u)] == f"Story {k} is told here" for k, u, _ in rows if u and "a.example" in u)
    assert got[(100, "https://user@B.example:8080/x")] == "Welcome to our site Story 1 is told here Bottom line"
    assert got[(101, None)].startswith("Welcome") and got[(102, "nonsense")] == ""
    assert html_main.extract(df.limit(0)).count() == 0


def test_articles_that_repeat_stay(spark):
    rows = [(k, f"http://a.example/{k}", "<nav>n</nav><article><p>The same story everywhere</p></article>") for k in range(20)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, PAGES).withColumns({c: F.lit("own") for c in ("host", "text", "hashes", "_h", "n")})
    got = html_main.extract(df)
    assert got.where("text = 'The same story everywhere'").count() == 20 and got.first()["host"] == "own"
    assert sorted(got.columns) == sorted(df.columns)


def test_large_template_tables_are_joined_by_key(spark, monkeypatch):
    monkeypatch.setattr(html_main, "BROADCAST_BYTES", -1)
    rows = [(k, "http://a.example/", f"<div>Welcome</div><p>text {k}</p>") for k in range(5)]
    got = html_main.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert {r["text"] for r in got} == {f"text {k}" for k in range(5)}


def test_query_gives_the_articles(spark, sf):
    import html
    import re

    from tidewright.llm.queries import op8_html_extraction

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op8_html_extraction(spark, sf).collect():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|li|ul|br|div)\b[^>]*>", body)
        want = " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)))
        assert r["text"] == want and r["n_chars"] == len(want)


def test_recurring_blocks_inside_articles_go(spark):
    """Boxes without a word of markup that tells, but not copies, cells or words in sentences."""
    box = "<div class=x1><p>Get the week in your inbox</p><ul><li>Here</li></ul></div><p>All rights are kept</p>"
    page = lambda k: f"<nav>n</nav><article><h1>Story {k}</h1><p><b>Note</b> on {k}</p><table><tr><td>total</td><td>{k}</td></tr></table>{box if k % 4 else ''}</article>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, f"http://b.example/{k}", page(1)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert all(got[k] == f"Story {k} Note on {k} total {k}" for k in range(12))
    assert all(got[100 + k] == "Story 1 Note on 1 total 1 Get the week in your inbox Here All rights are kept" for k in range(9))
