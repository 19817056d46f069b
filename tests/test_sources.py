"""HTML parsing, robots, sitemaps, walks, fetch outcomes and the monitoring stream."""

import pytest

from factweave.sources import crawl as S
from factweave.sources import html as H
from factweave.streaming import monitor

PAGE = """<!DOCTYPE html><html><head><title> A &amp; B </title><meta name=description content="About  it">
<meta property="og:site_name" content="Uni X"><script type="application/ld+json">[{"@type":"Org"},{"b":1}]</script>
<script type="application/ld+json">{broken</script><style>p{}</style><script>var t="</p><h1>no</h1>";</script></head><body>
<nav><img class="site-logo" src="/l.png" alt="Logo"><a href="/a">A</a><a href="mailto:x@y.z">M</a></nav>
<div class="cookie">Accept cookies</div><div class="no-sidebar"><h1>Online MBA<span>Finance</span></h1>
<p>First <b>para<p>Second<ul><li>One<li>Two</ul><h2>Fees</h2><p>Now <del>₹5</del> ₹4</p><h3>₹1,00,000</h3>
<table><tr><th>X<th>Y<tr><td>1<td>2<tr><td> <td></table><select><option value="">Pick<option value=1>Sem 1</select>
<img data-src="b.jpg" alt=" pic "><a href="https://other.org/apply">Apply now</a><span>own <i>child</i></span></div>
<footer>© 2024 Uni X. All rights reserved. <a href="#top">Top</a></footer></body></html>"""


def test_parse():
    p = H.parse(PAGE, "https://u.org/p/q")
    assert (p["title"], p["meta_description"], p["open_graph"], len(p["json_ld"])) == ("A & B", "About it", {"og:site_name": "Uni X"}, 2)
    assert [(h["level"], h["text"]) for h in p["headings"]] == [(1, "Online MBA Finance"), (2, "Fees"), (3, "₹1,00,000")]
    assert [(x["url"], x["relation"], x["link_type"]) for x in p["links"]] == [
        ("https://u.org/a", "internal", "navigation"), ("https://other.org/apply", "external", "cta"), ("https://u.org/p/q#top", "internal", "navigation"),
    ]
    texts = [(b["heading_context"], b["text"], b["struck"]) for b in p["blocks"]]
    assert ("Online MBA Finance", "First para", False) in texts and ("Online MBA Finance", "Two", False) in texts
    assert ("Fees", "Now ₹4", False) in texts and ("Fees", "₹5", True) in texts and ("Fees", "₹1,00,000", False) in texts and ("Fees", "Sem 1", False) in texts and ("Fees", "own", False) in texts
    assert not any("cookies" in t or t == "Pick" or "var t" in t for _, t, _ in texts)
    assert p["tables"] == [{"idx": 0, "heading_context": "Fees", "headers": ["X", "Y"], "rows": [["1", "2"]]}]
    assert p["images"] == [{"idx": 0, "heading_context": "Fees", "url": "https://u.org/p/b.jpg", "alt": "pic"}]
    assert p["logos"] == [{"idx": 0, "url": "https://u.org/l.png", "alt": "Logo", "hinted": True}] and p["footer_text"].startswith("© 2024 Uni X.")


@pytest.mark.parametrize("html", ["", "<", "<p", "plain", "<table><td>x", "</div></p>", "<a href='http://['>x</a>", "<b>" * 5000 + "x"])
def test_parse_never_fails(html):
    assert H.parse(html, "not a url")["links"] == []


def test_parse_stage(spark):
    df = spark.createDataFrame([(1, "https://u.org/p", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = H.parse_pages(df).orderBy("page_id").collect()
    assert got[0].ok and got[0].open_graph["og:site_name"] == "Uni X" and got[1].ok and got[1].title is None and got[0].tables[0].rows == [["1", "2"]]


def test_fetch_outcomes(spark):
    rows = [(200, "text/html; charset=x", "<p>"), (200, "text/html", " "), (200, "application/pdf", "x"), (404, "text/html", "x"), (None, None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, c string, b string")
    assert [r[0] for r in df.orderBy("i").select(S.fetch_outcome("s", "c", "b")).collect()] == [None, "empty_body", "non_html", "http_error", "unreachable"]


def test_robots(spark):
    text = "User-agent: a\nUser-agent: *\nDisallow: /x # c\nAllow: /x/y\n\nUser-agent: bot\nDisallow: /only\nSitemap: https://s.org/m.xml\n"
    files = spark.createDataFrame([(1, text)], "k int, t string")
    rules = lambda agent: sorted((r.kind, r.path) for r in S.parse_robots(files, "k", "t", agent).collect())
    assert rules("*") == [("allow", "/x/y"), ("disallow", "/x")] and rules("Bot") == [("disallow", "/only")] and rules("other") == rules("*")
    paths = spark.createDataFrame([(i, p) for i, p in enumerate(["/x", "/x/y/z", "/z", "/"])], "i int, p string")
    got = {r.p: r.allowed for r in S.robots_allowed(paths, S.parse_robots(files, "k", "t"), ["i"], "p").collect()}
    assert got == {"/x": False, "/x/y/z": True, "/z": True, "/": True}
    assert files.select(S.sitemap_directives("t")).first()[0] == ["https://s.org/m.xml"]


def test_sitemaps(spark):
    xml = "<urlset>" + "".join(f"<url><loc> https://u.org/{i}?a&amp;b </loc></url>" for i in range(3)) + "</urlset>"
    r = spark.createDataFrame([(xml,)], "x string").select(S.parse_sitemap("x", 2).alias("s")).first().s
    assert (r.kind, r.locs, r.truncated) == ("urlset", ["https://u.org/0?a&b", "https://u.org/1?a&b"], True)


def test_walk_and_top_up(spark):
    links = spark.createDataFrame(
        [("https://u.org", "https://u.org/a", 0), ("https://u.org", "https://v.org/b", 1), ("https://u.org", "https://u.org/a/", 2), ("https://u.org/a", "https://u.org/c", 0), ("https://u.org/a", "https://u.org/", 1), ("https://u.org/c", "https://u.org/d", 0)],
        "from_url string, to_url string, idx int",
    )
    start = spark.createDataFrame([("https://u.org", 0)], "url string, idx int")
    assert [(r.url, r.level) for r in S.walk(start, links, "u.org").orderBy("level", "url").collect()] == [("https://u.org", 0), ("https://u.org/a", 1), ("https://u.org/c", 2)]
    assert S.walk(start, links, "u.org", most=2).count() == 2
    targets = spark.createDataFrame([(1, ["mba", "finance"])], "target_idx int, keywords array<string>")
    urls = spark.createDataFrame([("https://u.org/blog/mba-finance", 0), ("https://u.org/mba", 1), ("https://u.org/mba-finance", 2), ("https://u.org/law", 3)], "url string, idx int")
    assert [(r.url, r.hits) for r in S.top_up(targets, urls).orderBy("rank").collect()] == [("https://u.org/mba-finance", 2), ("https://u.org/mba", 1), ("https://u.org/law", 0)]
    assert [r.url for r in S.top_up(targets, urls, most=1).collect()] == ["https://u.org/mba-finance"]
    nobody = spark.createDataFrame([(2, [])], "target_idx int, keywords array<string>")
    assert [r.url for r in S.top_up(nobody, urls, most=2).orderBy("rank").collect()] == ["https://u.org/mba", "https://u.org/mba-finance"]


def test_monitor(spark):
    path = "/root/testdata/sf0.001/events.parquet"
    got = monitor.monitor(spark, path)
    assert got.agg({"n": "sum"}).first()[0] == spark.read.parquet(path).count()
