"""Readers and the retrieval plan."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.plans.retrieve import Engine, json_result, text_block, url_arguments
from gleanery.sources import dom
from gleanery.sources import formats as S
from gleanery.sources import schemas
from gleanery.streaming.pages import first_arrivals, host_rates


def test_unclosed_inline_keeps_paragraphs_together():
    assert dom.blocks(dom.Page("<p><b>hi.<p>There</p>"))[0] == "hi.There"


def test_extract_page():
    page = dom.extract(
        '<html><head><title> T </title><meta property="og:title" content="O"><meta name="Description" content="D"><link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="/feed"></head>'
        '<body><nav><a href="#x">skip</a><a href="/one">One <i>link</i></a></nav><h1>Head</h1><p>A &amp; B</p><script type="application/ld+json">{"@graph":[{"a":1}]}</script></body></html>'
    )
    assert page["title"] == "T"
    assert dict(page["metadata"]) == {"title": "T", "og:title": "O", "description": "D"}
    assert page["canonical"] == "/c"
    assert [(x["href"], x["anchor_text"], x["feed"]) for x in page["links"]] == [("/one", "One link", False), ("/feed", None, True)]
    assert page["text"] == "Head\nA & B"
    assert page["json_ld"] == ['{"a": 1}']
    assert page["structured"] == "\n## Head\nA & B"
    assert not page["requires_browser"]


@pytest.mark.parametrize("html", ["", "<", "<div><p>", "</b></b>", "<table><tr><td>1", "<!-- open"])
def test_broken_html(html):
    assert dom.extract(html)["text"] is not None


def test_tables_and_shell():
    table = "<table><caption>C</caption><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"
    assert dom.tables(dom.Page(table)) == [{"caption": "C", "rows": [["a", "b"], ["1", "2"]]}]
    assert dom.tables(dom.Page("<table><tr><td>1</td></tr></table>")) == []
    assert dom.extract('<div id="root"></div><script src="a.js"></script>')["requires_browser"]


@pytest.mark.parametrize(
    ("body", "text", "links"),
    [('{"a": {"b": ["x", 1.0, true, null]}}', "[a.b[0]] x\n[a.b[1]] 1\n[a.b[2]] true", []), ('{"u": "https://x.y"}', "[u] https://x.y", ["https://x.y"]), ("{bad", "", []), ('["r"]', "[[0]] r", []), ("{}", "", [])],
)
def test_json(body, text, links):
    assert dom.json_text(body) == (text, links)


def test_json_depth():
    body = '{"k":' * 20 + "1" + "}" * 20
    assert dom.json_text(body) == ("", [])


def test_feeds_and_sitemaps(spark):
    feeds = spark.createDataFrame([("r", "<rss><channel><item><title>A</title></item><item><link>http://b</link><title>B</title></item></channel></rss>")], "url string, body string")
    assert [(r.title, r.link) for r in S.feed_items(feeds).orderBy("pos").collect()] == [("A", None), ("B", "http://b")]
    assert S.feed_text(S.feed_items(feeds)).first().text == "# A\n\n# B"
    broken = spark.createDataFrame([("m", "<urlset><url><loc>http://a/1</loc>"), ("n", "")], "url string, body string")
    assert S.sitemap_entries(broken).count() == 0


def test_paged_text(spark):
    rows = spark.createDataFrame([(1, 2, "two"), (1, 1, " one "), (2, 1, None)], "doc_id long, page_no int, page_text string")
    got = {r.doc_id: (r.text, r.requires_ocr) for r in S.paged_text(rows).collect()}
    assert got == {1: ("[Page 1] one\n\n[Page 2] two", False), 2: ("", True)}


def test_retrieve(spark):
    page = lambda body: bytearray(f"<html><head><title>Docs page</title></head><body>{body}</body></html>".encode())
    html = {"content-type": "text/html"}
    fetched = spark.createDataFrame(
        [
            ("https://a.com/", 200, html, page('<p>cache expiry and cache entries are described in the long introduction of this site</p><a href="/cache">Cache guide</a><a href="/other">Other</a>')),
            ("https://a.com/cache", 200, html, page("<p>cache entries expire after five minutes; the cache is cleared on restart of the server process</p>")),
            ("https://a.com/other", 200, html, page("<p>nothing to see</p>")),
            ("https://a.com/data.json", 200, {"content-type": "application/json"}, bytearray(b'{"cache": "json cache value"}')),
        ],
        schemas.FETCHED,
    )
    requests = spark.createDataFrame(
        [(1, 0, "https://a.com/", "how does the cache expire", "deep", None, None, datetime(2026, 1, 1)), (2, 0, "http://127.0.0.1/", "x", None, None, None, datetime(2026, 1, 1)), (3, 0, "https://a.com/data.json", "cache", None, None, None, datetime(2026, 1, 1)), (4, 0, "https://gone.com/", "x", None, None, None, datetime(2026, 1, 1))],
        schemas.REQUESTS,
    )
    results = Engine(spark, fetched).retrieve(requests).cache()
    rows = {r.query_id: r for r in results.collect()}
    assert [rows[i].status for i in (1, 2, 3, 4)] == ["success", "failed", "success", "not_found"]
    assert rows[2].error == "SSRF_BLOCKED"
    assert {s.url for s in rows[1].sources} == {"https://a.com/", "https://a.com/cache", "https://a.com/other"}
    assert all(0 <= e.relevance <= 1 for e in rows[1].evidence)
    assert rows[1].navigation.method == "exact"
    texts = {r.query_id: r.text for r in text_block(results).collect()}
    assert texts[1].startswith("STATUS: SUCCESS")
    assert "No relevant evidence" in texts[4]
    assert json_result(results, 1).count() == 4


def test_url_arguments(spark):
    rows = spark.createDataFrame([(["a", "", None], None), (None, "b"), ([], ""), (None, None)], "urls array<string>, url string")
    assert [r[0] for r in rows.select(url_arguments(F.col("urls"), F.col("url"))).collect()] == [["a"], ["b"], [], []]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://a.com/x#1", datetime(2026, 1, 1, 0, 0, 5)), (2, "http://a.com/x", datetime(2026, 1, 1, 0, 0, 9)), (3, "http://a.com/y", datetime(2026, 1, 1, 0, 2, 0))], "id long, url string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, url string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("arrivals", first_arrivals(stream, "ts"), "append", 2), ("rates", host_rates(stream.selectExpr("ts", "'a.com' AS host")), "complete", 2)):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        query.stop()
        assert spark.table(name).count() == n


def test_policy_holds_for_every_url(spark):
    html = {"content-type": "text/html"}
    page = lambda links: bytearray(f"<html><head><title>Docs page</title></head><body><p>the cache expires after five minutes and is cleared on restart</p>{links}</body></html>".encode())
    hrefs = "".join(f'<a href="{u}">cache</a>' for u in ("/ok", "http://169.254.169.254/x", "/moved"))
    fetched = spark.createDataFrame(
        [("https://a.com/", 200, html, page(hrefs)), ("https://a.com/ok", 200, html, page("")), ("https://a.com/target", 200, html, page("")), ("https://deny.com/", 200, html, page("")), ("https://sub.deny.com/x", 200, html, page("")), ("https://big.com/", 200, html | {"content-length": "9999999999"}, page("")), ("http://10.0.0.9/", 200, html, page(""))],
        schemas.FETCHED,
    )
    at = datetime(2026, 1, 1)
    asked = ["https://a.com/", "https://deny.com/", "https://sub.deny.com/x", "https://big.com/", "https://a.com/moved", "https://a.com/loop", "https://a.com/in"]
    requests = spark.createDataFrame([(i, 0, u, "cache expires", "deep", None, None, at) for i, u in enumerate(asked)], schemas.REQUESTS)
    redirects = spark.createDataFrame([("https://a.com/moved", "/target"), ("https://a.com/loop", "/loop2"), ("https://a.com/loop2", "/loop"), ("https://a.com/in", "http://10.0.0.9/")], schemas.REDIRECTS)
    found = spark.createDataFrame([(0, "http://10.0.0.9/", "cache", ""), (0, "https://sub.deny.com/x", "cache", ""), (0, "ftp://a.com/", "cache", "")], "query_id long, url string, title string, snippet string")
    engine = Engine(spark, fetched, deny=spark.createDataFrame([("deny.com",)], "domain string"), discovered=found, redirects=redirects)
    rows = {r.query_id: r for r in engine.retrieve(requests).collect()}
    assert [(rows[i].status, rows[i].error) for i in range(7)] == [
        ("success", None), ("blocked", "DOMAIN_DENIED"), ("blocked", "DOMAIN_DENIED"), ("failed", "RESPONSE_TOO_LARGE"), ("success", None), ("failed", "REDIRECT_LOOP"), ("failed", "SSRF_BLOCKED"),
    ]
    assert {s.url for s in rows[0].sources} == {"https://a.com/", "https://a.com/ok", "https://a.com/target"}
    assert (rows[4].navigation.method, rows[4].navigation.resolved_url) == ("redirect", "https://a.com/target")
    d = rows[0].diagnostics
    assert (d.http_requests, d.pages_fetched, d.documents_parsed, d.candidates_considered, d.mode, d.budget_exhausted) == (3, 3, 3, 4, "deep", False)


def test_schedule(spark):
    from gleanery.operators.policy import schedule

    rows = [(1, "a", datetime(2026, 1, 1, 0, 0, 0)), (2, "a", datetime(2026, 1, 1, 0, 0, 0)), (3, "a", datetime(2026, 1, 1, 0, 0, 9)), (4, "b", datetime(2026, 1, 1)), (5, "b", datetime(2026, 1, 1))]
    delays = spark.createDataFrame([("a", 2.0)], "host string, crawl_delay double")
    got = {r.request_id: r.wait_ms for r in schedule(spark.createDataFrame(rows, "request_id long, host string, ts timestamp"), delays).collect()}
    assert got == {1: 0, 2: 2000, 3: 0, 4: 0, 5: 500}
