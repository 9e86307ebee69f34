"""Small inline tables for queries whose inputs the data directory doesn't have."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

QUERY = "thanedble reing attion"
AS_OF = datetime(2026, 1, 1)

URLS = [
    (1, "http://localhost/x"), (2, "http://10.1.2.3/"), (3, "https://172.20.0.1/a"), (4, "http://192.168.1.1:8080/"), (5, "http://169.254.169.254/latest"), (6, "http://8.8.8.8/"),
    (7, "http://100.64.1.1/"), (8, "http://172.32.0.1/"), (9, "http://240.0.0.1/"), (10, "https://example.com:8443/"), (11, "http://example.com:22/"), (12, "ftp://example.com/"), (13, "not a url"), (14, "http://internal.example.org/"),
]
IPV6 = ["::1", "::", "fc00::1", "fdab::2", "fe80::1", "febf::1", "fec0::1", "ff02::1", "2001:db8::1", "2001:4860:4860::8888", "100::1", "100:0:0:1::1", "::ffff:10.0.0.1", "::ffff:a00:1", "::ffff:808:808"]
PORTS = [80, 443, 8080, 8443, 22, 25, 3306, 5432, 6379, 27017]
DNS = [("internal.example.org", "10.0.0.5"), ("internal.example.org", "93.184.216.34"), ("example.com", "93.184.216.34")]
REDIRECTS = [
    ("http://a.com/1", "/2"), ("http://a.com/2", "http://b.com/3"), ("http://loop.com/x", "http://loop.com/y"), ("http://loop.com/y", "http://loop.com/x"), ("http://long.com/0", "http://long.com/1"),
    ("http://long.com/1", "http://long.com/2"), ("http://long.com/2", "http://long.com/3"), ("http://long.com/3", "http://long.com/4"), ("http://long.com/4", "http://long.com/5"), ("http://long.com/5", "http://long.com/6"),
    ("http://private.com/", "http://192.168.0.1/admin"), ("http://scheme.com/", "ftp://scheme.com/file"),
]
ROBOTS = [
    ("https://a.com", 200, "User-agent: *\nDisallow: /private/\nAllow: /private/open\nCrawl-delay: 2\n\nUser-agent: gleanery\nUser-agent: other\nDisallow: /tmp # scratch\nDisallow: /*.pdf$\nSitemap: https://a.com/sitemap.xml\n"),
    ("https://b.com", 200, "User-agent: *\r\nDisallow: /same\r\nAllow: /same\r\nDisallow: /q?\r\nno colon here\r\n"),
    ("https://c.com", 404, ""),
    ("https://d.com", 503, ""),
    ("https://e.com", 200, "User-agent: *\nDisallow:\n"),
    ("https://f.com", 200, "Disallow: /early\nUser-agent: *\nDisallow: /x/*/y\n"),
]
ROBOT_URLS = [
    "https://a.com/private/x", "https://a.com/tmp/1", "https://a.com/doc.pdf", "https://a.com/doc.pdf?x=1", "https://b.com/same/1", "https://b.com/q?a=1", "https://b.com/qa", "https://c.com/any", "https://d.com/any", "https://e.com/any",
    "https://f.com/early", "https://f.com/x/1/y/2", "https://f.com/x/y", "https://unknown.com/z",
]
BODIES = [
    (1, "text/html; charset=utf-8", b"<p>x"), (2, "text/xml", b"<?xml version='1.0'?><rss>"), (3, "application/octet-stream", b"%PDF-1.7"), (4, "", b"\xff\xd8\xff\xe0"), (5, "text/plain", b"  {\"a\": 1}"), (6, None, b"\x89PNG\r\n\x1a\n"),
    (7, "image/jpg", b""), (8, "text/plain", b"just words"), (9, "", b"just words"), (10, "application/xml", b"<feed xmlns='x'>"), (11, "unknown", b"RIFF\x10\x00\x00\x00WEBPVP8 "), (12, "TEXT/JavaScript", b"x"), (13, "", b"<!DOCTYPE html><html>"), (14, "application/xml", b"<rss version='2.0'>"),
]
RETRIES = [(1, "30", 0), (2, "120", 0), (3, None, 0), (4, None, 2), (5, None, 9), (6, "Thu, 01 Jan 2026 00:00:10 GMT", 1), (7, "Wed, 31 Dec 2025 00:00:00 GMT", 1), (8, "soon", 1)]
QUERIES = [(1, "install all plugins on the latest server"), (2, "login"), (3, "how does the session cache expire entries"), (4, "getting auth error"), (5, "Every price"), (6, "database performance tuning for slow queries")]
SITEMAPS = [
    ("https://a.com/sitemap.xml", "<?xml version='1.0'?><sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><sitemap><loc>https://a.com/one.xml</loc></sitemap><sitemap><loc>https://a.com/two.txt</loc></sitemap></sitemapindex>"),
    ("https://a.com/one.xml", "<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc> https://a.com/guide </loc><lastmod>2025-06-01</lastmod><priority>0.8</priority></url><url><loc>https://a.com/zero</loc><priority>0</priority></url><url><loc>/relative</loc></url></urlset>"),
    ("https://a.com/two.txt", "https://a.com/text\r\n\r\nnot a location\nhttp://a.com/plain\n"),
]
FEEDS = [
    ("https://a.com/rss", "<rss version='2.0'><channel><title>News</title><item><title>One</title><link>https://a.com/1</link><description>&lt;b&gt;Bold&lt;/b&gt;  text</description><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item><item><title>Two</title><link>https://a.com/2</link></item></channel></rss>"),
    ("https://a.com/atom", "<feed xmlns='http://www.w3.org/2005/Atom'><title>Log</title><entry><title>Only</title><link href='https://a.com/3'/><updated>2024-02-03</updated><content>Body</content></entry></feed>"),
]
STRUCTURED = [
    (1, "https://a.com/p", '<html><head><title>T &amp; U</title><meta name="description" content="d"><link rel="canonical" href="/canon"><script type="application/ld+json">{"@graph":[{"@type":"A"},{"@type":"B"}]}</script></head><body><h1>Head</h1><p>Para <b>bold</b></p><div>loose</div><table><caption>Cap</caption><tr><th>k</th><th>v</th></tr><tr><td>a</td><td>1</td></tr></table><dl><dt>t</dt><dd>d</dd></dl><span itemprop="price" content="9">x</span></body></html>'),
    (2, "https://a.com/app", '<html><body><div id="root"></div><script src="x.js"></script></body></html>'),
    (3, "https://a.com/next", '<html><body><script id="__NEXT_DATA__" type="application/json">{"props":{"title":"A sufficiently long title"}}</script></body></html>'),
]
ASKED = [
    (1, "https://a.com/docs/install", None), (2, "https://a.com/docs/install/?utm_source=x", None), (3, "https://a.com/moved", "https://a.com/docs/config"), (4, "https://a.com/docs/authentication-guide", None), (5, "https://a.com/zzz", None), (6, "https://b.com/docs/install", None),
]
OBSERVED = [("https://a.com/docs/install", 1, None, None), ("https://a.com/docs/config", 2, None, 0.5), ("https://a.com/docs/auth-guide", 3, "Authentication guide", 0.9), ("https://a.com/", 4, "Home", 1.0)]


def frame(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
