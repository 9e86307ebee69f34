"""Registered queries over the operators of operators/signals.py and functions/intent.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intent as I
from ..functions import text as T
from ..functions import url as U
from ..operators import candidates as C
from ..operators import signals as N
from ..sources import formats as S
from . import fixtures as X
from .derived import _pick, _text, table

BASE = "https://www.spam-farm.example.org/"
ASKED = "english thing 825 example"


def _asked(spark, sf_dir):
    key = F.col("conv_id")
    more = _pick(key, "latest api release?", "research paper on this", "price table", "how does it work?", "announcement")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat_ws(" ", F.substring_index("text", " ", 3), more).alias("query"))


def query_intent(spark, sf_dir):
    return _asked(spark, sf_dir).select("conv_id", "turn", I.query_intent(F.col("query")).alias("i")).select("conv_id", "turn", "i.*")


def query_variants(spark, sf_dir):
    rows = _asked(spark, sf_dir).select("conv_id", "turn", F.posexplode(I.query_variants(F.col("query"), F.col("turn") != 2)).alias("pos", "variant"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def field_bm25(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", S.page_title(F.col("html")).alias("title"), U.path_words(F.col("url")).alias("address"), T.strip_tags(F.col("html")).alias("body"))
    asked = X.frame(spark, [(1, X.QUERY), (2, ASKED)], "query_id long, query string")
    found = N.field_bm25(pages, asked, {"title": "title", "address": "url", "body": "body"}, "page_id")
    return found.select("query_id", "page_id", F.round("score", 6).alias("score"), "phrase")


def _scores(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", S.page_title(F.col("html")).alias("title"))
    return pages.withColumn("score", F.round(C.url_score(F.col("url"), F.lit(ASKED), F.lit(BASE), F.lit(X.AS_OF)), 6))


def candidate_score(spark, sf_dir):
    made = N.adjusted_scores(_scores(spark, sf_dir).withColumn("url", _pick(F.col("page_id"), F.col("url"), F.col("url"), _text(F.regexp_extract("url", "^(https?://[^/?#]*)", 1), "/about/us"))), F.lit(X.QUERY), ["page_id"])
    return made.select("page_id", F.round("score", 6).alias("score"))


def diverse_sites(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("query_id", F.col("page_id") % 7)
    return N.diverse_sites(rows, ties=("page_id",)).select("query_id", "rank", "page_id", "score")


def site_relation(spark, sf_dir):
    url = _pick(F.col("page_id"), F.col("url"), _text("https://m.spam-farm.example.org/", F.col("page_id")), _text("https://cdn.a.co.uk/", F.col("page_id")), _text(BASE, F.col("page_id")), "mailto:x@y.z")
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    return pages.select("page_id", N.site(F.col("url")).alias("site"), N.site_relation(F.col("url"), F.lit(BASE), ["example.net"]).alias("relation"))


def evidence_agreement(spark, sf_dir):
    claims = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("source"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).when(F.col("o_custkey") % 6 != 0, F.lit("x")).alias("value"))
    return N.agreement(claims, ["o_custkey"])


def freshness(spark, sf_dir):
    key, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    http = F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss")
    null = F.lit(None).cast("string")
    made = N.freshness(F.when(key % 5 == 0, iso).when(key % 5 == 1, "soon"), F.when(key % 5 == 1, iso), F.when(key % 5 == 2, _text(http, " GMT")), F.when(key % 5 == 3, iso), F.when(key % 2 == 0, _text(http, " GMT")).otherwise(null))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("f")).select("o_orderkey", F.unix_seconds("f.at").alias("at"), "f.signal")


def provenance(spark, sf_dir):
    key = F.col("o_orderkey")
    section = _pick(key, _text("Page ", key), "Intro", F.lit(None).cast("string"))
    text = _pick(F.floor(key / 3), _text("[order.tags[", key % 9, "]] x"), "plain [a] text", _text("[status] ", F.col("o_orderstatus")))
    made = N.provenance(text, section, _pick(key, " ", F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("p")).select("o_orderkey", "p.*")


def index_directives(spark, sf_dir):
    key = F.col("page_id")
    html = F.concat(_pick(key, "", '<meta name="robots" content="noindex, nofollow">', "<META NAME='Robots' CONTENT='none'>", '<meta name="robots" content="index,noarchive">'), F.col("html"))
    header = _pick(F.floor(key / 4), F.lit(None).cast("string"), "nosnippet", "NOINDEX")
    return table(spark, sf_dir, "pages").select("page_id", N.directives(html, header).alias("d")).select("page_id", "d.*")


def skip_reason(spark, sf_dir):
    url, i = F.col("url"), F.col("page_id")
    base = F.regexp_extract(url, "^(https?://[^/?#]*)", 1)
    made = _pick(i, _text(base, "/p/", i), _text(base, "/cart/add"), _text(base, "/x.CSS"), _text(base, "/item?do=delete&id=", i), _text("https://www.google-analytics.com/c/", i), _text(base, "/delivery"))
    return table(spark, sf_dir, "pages").select("page_id", N.skip_reason(made).alias("reason"))


def resource_links(spark, sf_dir):
    key = F.col("p_partkey")
    html = _text("<link rel=icon href='/i", key, ".ico'><a class=x href=\"/a", key, "\">a</a><img alt='' src='/m", key, ".png'><form method=post action='/f'></form>", F.when(key % 2 == 0, "<iframe src='/fr'></iframe><script src='/s.js'></script>").otherwise("<script>var x;</script>"))
    made = table(spark, sf_dir, "part").select((-1 - key).alias("page_id"), html.alias("html"))
    return N.resource_links(table(spark, sf_dir, "pages").select("page_id", "html").unionByName(made))


def status_action(spark, sf_dir):
    status = _pick(F.col("o_orderkey"), 200, 204, 301, 304, 403, 404, 408, 429, 503, 400, F.lit(None).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.status_action(status).alias("action"))


def site_index(spark, sf_dir):
    key = F.col("c_custkey")
    head = _text("<html lang=EN><head><title>", F.col("c_name"), "</title><meta name='description' content=' about  ", key, "'><link rel='canonical' href='/c/", key, "'></head><h1>One</h1><p>x</p><h2> <i>Two</i> ", key, "</h2><h3></h3></html>")
    made = table(spark, sf_dir, "customer").select((-1 - key).alias("page_id"), _text("https://c.com/page/", key).alias("url"), head.alias("html"))
    found = N.site_index(table(spark, sf_dir, "pages").select("page_id", "url", "html").unionByName(made))
    return found.withColumn("headings", F.array_join("headings", "\n"))


def evaluation(spark, sf_dir):
    key = F.col("o_orderkey")
    asked, other = _text("https://a.com/", key), _text("https://a.com/z", key)
    cases = table(spark, sf_dir, "orders").select("o_orderpriority", _text(asked, "/").alias("asked"), F.when(key % 7 != 0, _pick(key, asked, other)).alias("expected"), _pick(F.floor(key / 2), asked, other, F.lit(None).cast("string")).alias("returned"))
    found = N.evaluation(cases, ["o_orderpriority"])
    return found.select("o_orderpriority", "n_cases", *[F.round(c, 6).alias(c) for c in found.columns[2:]])


NAMES = [
    "query_intent", "query_variants", "field_bm25", "candidate_score", "diverse_sites", "site_relation", "evidence_agreement", "freshness", "provenance", "index_directives", "skip_reason", "resource_links", "status_action",
    "site_index", "evaluation",
]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}
