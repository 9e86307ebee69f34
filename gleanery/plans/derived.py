"""Registered queries whose inputs (markup, files, addresses, redirects) are written from whole tables of the data directory.

Lists inside one made file have a fixed size, so that files grow in number with the data and not in length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import mime as M
from ..functions import planning as P
from ..functions import text as T
from ..functions import url as U
from ..operators import candidates as C
from ..operators import evidence as E
from ..operators import policy as R
from ..sources import formats as S
from . import fixtures as X
from .retrieve import Engine

FILE = 100  # entries of a made sitemap
FEED = 50  # items of a made feed
RETRY_AS_OF = "1996-06-01"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    """Strings and columns (given by name in braces or as Column) in a row."""
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _pick(key: Column, *values) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def _joined(rows: DataFrame, keys: list[str], order: str, item: Column) -> DataFrame:
    """keys, body: the items of each key in order, one after another."""
    made = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("t")))).alias("items"))
    return made.select(*keys, F.array_join(F.col("items.t"), "").alias("body"))


# --- addresses and policy ---------------------------------------------------------------------


def url_error(spark, sf_dir):
    pages, i, url = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url")
    made = _pick(i, url, F.regexp_replace(url, "^https?", "ftp"), F.regexp_replace(url, "^(https?://[^/?#]*)", "$1:22"), F.regexp_replace(url, "^(https?://[^/?#]*)", "$1:8443"), _text("not a url ", i))
    return pages.select("page_id", U.url_error(made).alias("error"))


def safe_port(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", U.safe_port((F.col("o_orderkey") % 10_000).cast("int")).alias("safe"))


def _ipv4(key: Column) -> Column:
    return _text(_pick(key, 10, 172, 192, 169, 127, 100, 8, 224, 0, 198), ".", F.floor(key / 10) % 256, ".", key * 7 % 256, ".", key % 256)


def ssrf_ipv4(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    own = orders.select(key.alias("id"), _text("http://", _ipv4(key), "/a").alias("url"))
    named = table(spark, sf_dir, "customer").select((-1 - F.col("c_custkey")).alias("id"), _text("https://h", F.col("c_custkey"), ".example:8443/").alias("url"))
    dns = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(_text("h", F.col("c_custkey"), ".example").alias("host"), _ipv4(F.col("c_custkey")).alias("address"))
    return R.ssrf(own.unionByName(named), dns).select("id", "ssrf_blocked")


def ssrf_ipv6(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    tail = F.lower(F.hex(key % 65_536))
    whole = _text(F.lower(F.hex(key * 37 % 65_536)), ":0:0:0:0:0:0:", tail)
    made = _pick(key, whole, whole, _text("2001:db8::", tail), _text("100::", tail), _text("::ffff:", _ipv4(key)), _text("[fe80::", tail, "]"), _text("2600::", tail))
    return orders.select("o_orderkey", R.blocked_ip(made).alias("blocked"))


def _robots(spark, sf_dir) -> DataFrame:
    """origin, status, text: one of five files for each origin of the pages."""
    files = table(spark, sf_dir, "pages").select(U.origin(F.col("url")).alias("origin")).distinct()
    n = F.length("origin")
    text = _pick(n, "User-agent: *\nDisallow: /en/\nAllow: /en/1\n", "User-agent: other\nDisallow: /\n\nUser-agent: gleanery\nDisallow: /*.html$ # pages\n", "# open\nUser-agent: *\nDisallow:\nCrawl-delay: 3\n", "", "User-agent: *\r\nDisallow: /\r\n")
    return files.select("origin", _pick(n, 200, 200, 200, 503, 404).alias("status"), text.alias("text"))


def robots_allowed(spark, sf_dir):
    return R.robots_allowed(table(spark, sf_dir, "pages").select("page_id", "url"), _robots(spark, sf_dir)).select("page_id", "allowed")


def robots_groups(spark, sf_dir):
    groups = R.robots_groups(_robots(spark, sf_dir))
    return groups.select("origin", F.col("group_no").cast("long").alias("group_no"), F.array_join("agents", ",").alias("agents"), F.size("rules").alias("n_rules"), "crawl_delay")


def crawl_delay(spark, sf_dir):
    return R.crawl_delay(_robots(spark, sf_dir)).select("origin", "crawl_delay")


def redirect_chain(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    halves = orders.where("o_orderkey > 0").select(_text("http://h.example/", key).alias("from_url"), _text("/", F.floor(key / 2)).alias("to_url"))
    loops = orders.select(_text("http://loop.example/", key).alias("from_url"), _text("/", key.bitwiseXOR(F.lit(1))).alias("to_url"))
    starts = orders.select(F.explode(F.array(_text("http://h.example/", key), _text("http://loop.example/", key))).alias("url"))
    return R.redirect_chain(starts, halves.unionByName(loops))


def rate_schedule(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), _text(F.col("event_type"), F.col("user_id")).alias("host"), "ts")
    return R.schedule(log, gap_ms=3_600_000).select("request_id", "wait_ms")


def retry_delay(spark, sf_dir):
    orders, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    given = _pick(key, (key % 50).cast("string"), F.lit(None).cast("string"), _text(F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss"), " GMT"), F.lit("soon"))
    return orders.select("o_orderkey", P.retry_delay_ms(given, F.floor(key / 4) % 7, F.lit(RETRY_AS_OF).cast("timestamp")).alias("delay_ms"))


def body_limits(spark, sf_dir):
    body = F.encode("html", "UTF-8")
    declared = _pick(F.col("page_id"), F.octet_length(body).cast("bigint"), F.lit(None).cast("bigint"), F.lit(1).cast("bigint"), F.lit(1 << 40))
    return table(spark, sf_dir, "pages").select("page_id", M.body_error(body, declared, 6000).alias("error"))


def mime_detect(spark, sf_dir):
    i = F.col("page_id")
    header = _pick(i, "text/html; charset=utf-8", "application/octet-stream", "Text/Plain", "", "image/jpg", F.lit(None).cast("string"))
    body = _pick(F.floor(i / 6), F.col("html"), F.lit(' {"a": 1}'), F.lit("%PDF-1.7"), F.lit("just words"), F.lit("<rss version='2.0'>"))
    return table(spark, sf_dir, "pages").select("page_id", M.detect(header, F.encode(body, "UTF-8")).alias("mime"))


# --- sitemaps, feeds, repair ------------------------------------------------------------------


def _sitemaps(spark, sf_dir) -> DataFrame:
    """url, body: for every FILE customers an index at a usual path and the sitemap it lists."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").withColumn("origin", _text("https://n", F.floor(key / FILE), ".com"))
    item = _text("<url><loc> ", F.col("origin"), "/c/", key, " </loc>", F.when(key % 2 == 0, _text("<lastmod>2025-01-0", key % 9 + 1, "</lastmod>")).otherwise(""), "<priority>0.", key % 10, "</priority></url>")
    urls = _joined(rows, ["origin"], "c_custkey", item)
    listed = urls.select(_text(F.col("origin"), "/part.xml").alias("url"), _text("<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>", F.col("body"), "</urlset>").alias("body"))
    index = urls.select(_text(F.col("origin"), "/sitemap_index.xml").alias("url"), _text("<sitemapindex><sitemap><loc>", F.col("origin"), "/part.xml</loc></sitemap></sitemapindex>").alias("body"))
    return listed.unionByName(index)


def sitemap_entries(spark, sf_dir):
    return S.sitemap_entries(_sitemaps(spark, sf_dir)).select("url", "loc", "lastmod", "priority")


def sitemap_discovery(spark, sf_dir):
    origins = table(spark, sf_dir, "customer").select(_text("https://n", F.floor(F.col("c_custkey") / FILE), ".com").alias("origin")).distinct()
    none = spark.createDataFrame([], "origin string, url string")
    return S.discover_sitemaps(origins, none, _sitemaps(spark, sf_dir)).select("origin", "url", F.col("pos").cast("long").alias("pos"))


def find_in_sitemap(spark, sf_dir):
    entries = S.sitemap_entries(_sitemaps(spark, sf_dir)).select(F.col("loc").alias("url"), "lastmod", "priority", "pos")
    key = F.col("o_custkey")
    asked = table(spark, sf_dir, "orders").select(_text("https://N", F.floor(key / FILE), ".com/c/", key, _pick(F.col("o_orderkey"), "", "?utm_source=x", "/", "/more")).alias("url")).distinct()
    return C.find_in_sitemap(asked, entries)


def feed_items(spark, sf_dir):
    key = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").withColumn("n", F.floor(key / FEED))
    one = _text("<item><title>", F.col("s_name"), "</title><link>https://s.com/", key, "</link>", F.when(key % 2 == 0, _text("<description>&lt;b&gt;No ", key, "&lt;/b&gt;  ok</description>")).otherwise("<pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate>"), "</item>")
    two = _text("<entry><title>", F.col("s_name"), "</title><link href='https://s.com/", key, "'/><updated>2024-02-0", key % 9 + 1, "</updated><summary>S", key, "</summary></entry>")
    rss = _joined(rows, ["n"], "s_suppkey", one).select(_text("https://s.com/rss/", F.col("n")).alias("url"), _text("<rss version='2.0'><channel><title>t</title>", F.col("body"), "</channel></rss>").alias("body"))
    atom = _joined(rows, ["n"], "s_suppkey", two).select(_text("https://s.com/atom/", F.col("n")).alias("url"), _text("<feed xmlns='http://www.w3.org/2005/Atom'><title>t</title>", F.col("body"), "</feed>").alias("body"))
    return S.feed_items(rss.unionByName(atom)).select("url", F.col("pos").cast("long").alias("pos"), "title", "date", "summary", "link")


def url_repair(spark, sf_dir):
    pages, i = table(spark, sf_dir, "pages"), F.col("page_id")
    asked = _pick(i, F.col("url"), _text(F.regexp_replace("url", "#.*$", ""), "#zz"), _text("https://moved.invalid/", i), _text("https://nowhere.invalid/", i))
    rows = pages.select(i.alias("query_id"), asked.alias("url"), F.when(i % 4 == 2, F.col("url")).alias("canonical"))
    return C.repair_urls(rows, pages.select("url", i.alias("pos"), F.lit(None).cast("string").alias("anchor_text"), F.lit(None).cast("double").alias("priority"))).drop("url")


def canonical_dedupe(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    own = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "/[0-9]+", "/x")
    return E.dedupe_by_canonical(pages, pages.where("page_id % 3 <> 0").select("url", own.alias("canonical")).distinct(), ["page_id"]).select("page_id")


def query_plan(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    null = lambda kind: F.lit(None).cast(kind)
    asked = turns.select("query_id", F.lit(0).alias("pos"), _pick(F.col("query_id"), "Docs", "https://a.com/x", "unknown").alias("url"), F.col("text").alias("query"), null("string").alias("mode"), null("int").alias("max_pages"), F.when(F.col("query_id") % 2 == 0, 5).alias("max_internal_requests"), null("timestamp").alias("as_of"))
    plan = Engine(spark, spark.createDataFrame([], "url string, status int, headers map<string,string>, body binary"), hints=X.frame(spark, [("docs", "https://docs.example.com/")], "name string, url string")).plan(asked)
    return plan.select("query_id", "url", "mode", "max_pages", "max_internal_requests", "error")


def expand_tokens(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", "text", _pick(F.col("conv_id"), "login error", "install config", "price list", "fast docs")).alias("query"))
    return asked.select("conv_id", "turn", F.explode(P.expand_tokens(F.col("query"))).alias("token"))


def token_set(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.token_set(F.col("text"))), " ").alias("tokens"))


def resolve_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", P.infer_mode(F.col("text")).alias("mode"))
    given = F.when(F.col("turn") == 2, 9).cast("int")
    return rows.select("conv_id", "turn", P.max_pages(F.col("mode"), given).alias("max_pages"), P.max_requests(F.col("mode")).alias("max_internal_requests"))


# --- documents --------------------------------------------------------------------------------


def _pages(spark, sf_dir) -> DataFrame:
    return S.extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def html_structural(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", "extracted.text", "extracted.structured", F.array_join("extracted.sections", "\n").alias("sections"))


def html_links(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", F.posexplode("extracted.links").alias("pos", "l")).select("page_id", F.col("pos").cast("long").alias("pos"), "l.href", "l.anchor_text")


def html_metadata(spark, sf_dir):
    key = F.col("c_custkey")
    head = _text("<html><head><title> ", F.col("c_name"), " </title><title>later</title><META name='Description' content='", F.col("c_mktsegment"), "'><meta name=description content=later><meta property='og:title' content='O", key, "'><link rel=canonical href='/c/", key, "?x=1'><link rel=alternate hreflang=fr href=/fr></head>")
    made = table(spark, sf_dir, "customer").select((-1 - key).alias("page_id"), _text("https://c.com/page/", key).alias("url"), head.alias("html"))
    rows = S.extract_html(table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(made))
    meta = S.page_metadata(F.col("extracted.metadata"))
    return rows.select("page_id", meta["title"].alias("title"), meta["description"].alias("description"), meta["og_title"].alias("og_title"), F.try_element_at(meta["alternates"], F.lit("fr")).alias("fr"), U.resolve(F.col("extracted.canonical"), F.col("url")).alias("canonical"))


def html_tables(spark, sf_dir):
    key = F.col("p_partkey")
    html = _text("<table><caption> B ", F.col("p_brand"), "</caption><thead><tr><th>key<th>name</thead><tr><td>", key, "<td><b>", F.col("p_name"), "</b></tr>", F.when(key % 2 == 0, _text("<tr><td>size</td><td>", F.col("p_size"), "</td></tr>")).otherwise(""), "</table><table><tr><td>one</td></tr></table>")
    rows = S.extract_html(table(spark, sf_dir, "part").select("p_partkey", html.alias("html"))).select("p_partkey", F.posexplode("extracted.tables").alias("pos", "t"))
    return rows.select("p_partkey", F.col("pos").cast("long").alias("pos"), "t.caption", S.table_markdown(F.col("t.rows")).alias("markdown"))


def structured_data(spark, sf_dir):
    key = F.col("p_partkey")
    entity = _text('{"@type": "Product", "name": "', F.col("p_name"), '", "size": ', F.col("p_size"), "}")
    block = F.when(key % 2 == 0, _text('{"@graph":[', entity, ',{"n":1}]}')).when(key % 3 == 0, _text("{bad", entity)).otherwise(entity)
    html = _text('<script type="application/LD+json"> ', block, ' </script><p itemprop="brand">', F.col("p_brand"), '</p><a itemprop="brand" href="/later">x</a><a itemprop="page" href="/p/', key, '">x</a><span property="v:kind"> ', F.col("p_type"), " </span>")
    found = S.extract_html(table(spark, sf_dir, "part").select("p_partkey", html.alias("html")))
    value = lambda name: F.try_element_at("extracted.microdata", F.lit(name)).alias(name.split(":")[-1])
    return found.select("p_partkey", F.array_join("extracted.json_ld", "\n").alias("json_ld"), value("brand"), value("page"), value("v:kind"))


def app_state(spark, sf_dir):
    """State that scripts assign or hold, and the strings of it that count as text."""
    key = F.col("event_id")
    state = _text('{"kind": "', F.col("event_type"), '", "event": ', F.col("props"), ', "note": "event number ', key, ' of user ', F.col("user_id"), '", "deep": [["', F.col("event_type"), ' happened again"]]}')
    html = _pick(key, _text('<script id="__NEXT_DATA__" type="application/json">', state, "</script>"), _text("<script>var a = {}; window.__STATE__ = ", state, "; self.OTHER={bad};</script>"), _text('<script type="application/json">', state, "</script>"))
    found = S.extract_html(table(spark, sf_dir, "events").select("event_id", html.alias("html")))
    entry = F.get(F.map_entries("extracted.app_data"), 0)
    return found.select("event_id", F.size("extracted.app_data").alias("n"), entry["key"].alias("key"), entry["value"].alias("value"), "extracted.text", "extracted.requires_browser")


def spa_shell(spark, sf_dir):
    key = F.col("c_custkey")
    html = _text("<html><head>", _pick(key, "", '<meta property="og:title" content="O">', "", '<meta name="description" content="d">'), '</head><body><div id="root">', F.repeat(F.lit("<p>words</p>"), (key % 30).cast("int")), "</div>", F.when(key % 7 == 0, '<script type="application/json">{"a": 1}</script>').otherwise('<script src="x.js"></script>'))
    made = table(spark, sf_dir, "customer").select((-1 - key).alias("page_id"), html.alias("html"))
    return S.extract_html(table(spark, sf_dir, "pages").select("page_id", "html").unionByName(made)).select("page_id", "extracted.requires_browser")


def json_document(spark, sf_dir):
    """Nested JSON: objects, lists beyond the item limit, numbers, booleans, nulls and links."""
    key = F.col("o_orderkey")
    body = _text('{"order": {"key": ', key, ', "price": ', F.col("o_totalprice"), ', "tags": ["', F.col("o_orderpriority"), '", null, true], "url": "https://o.com/', key % 10, '"}, "status": "', F.col("o_orderstatus"), '", "empty": ""', F.when(key % 5 == 0, ",").otherwise("}"))
    found = S.extract_json(table(spark, sf_dir, "orders").select("o_orderkey", body.alias("body")))
    return found.select("o_orderkey", "extracted.text", F.array_join("extracted.links", " ").alias("links"))


def xml_text(spark, sf_dir):
    key = F.col("p_partkey")
    body = _text("<?xml version='1.0'?><parts><part url='https://p.com/", key, "'><name> ", F.col("p_name"), " </name><size>", F.col("p_size"), "</size></part><img href='/no'/><ref loc='http://q.com/'/><ref loc='http://q.com/'/></parts>")
    found = S.extract_xml(table(spark, sf_dir, "part").select("p_partkey", body.alias("body")))
    return found.select("p_partkey", "extracted.text", F.array_join("extracted.links", " ").alias("links"))


def paged_text(spark, sf_dir):
    """Documents dealt to pages of 500 characters; the hundred first count."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil(F.length("text") / 500), F.lit(1)).cast("int"))).alias("page_no"))
    return S.paged_text(rows.select("doc_id", "page_no", F.expr("substring(text, (page_no - 1) * 500 + 1, 500)").alias("page_text")))


NAMES = [
    "url_error", "safe_port", "ssrf_ipv4", "ssrf_ipv6", "robots_allowed", "robots_groups", "crawl_delay", "redirect_chain", "rate_schedule", "retry_delay", "body_limits", "mime_detect", "sitemap_entries", "sitemap_discovery",
    "find_in_sitemap", "feed_items", "url_repair", "canonical_dedupe", "query_plan", "expand_tokens", "token_set", "resolve_budget", "html_structural", "html_links", "html_metadata", "html_tables", "structured_data", "app_state",
    "spa_shell", "json_document", "xml_text", "paged_text",
]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
