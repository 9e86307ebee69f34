"""Signals that rank, filter and judge sources: fields, diversity of sites, agreement, freshness, directives, relations, provenance, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.planning import parse_time
from ..functions.text import collapse, is_term, raw_words, stem, token_count, tokens
from ..sources.formats import page_title
from .bm25 import idf, query_terms, saturation

# Weights of a page's fields.
FIELD_WEIGHTS = {"title": 3.0, "headings": 3.0, "metadata": 2.0, "body": 1.0, "url": 1.5}
TITLE_WEIGHT, BOILERPLATE_PENALTY, DUPLICATE_PENALTY, PER_SITE = 0.2, 0.15, 0.3, 3

# Last labels under which sites register one level deeper.
SECOND_LEVEL = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.bd"]
BOILERPLATE = ["about", "contact", "privacy", "terms", "cookies", "login", "signup", "careers", "legal", "imprint"]
ACTIONS = ["delete", "remove", "logout", "signout", "login", "signin", "signup", "register", "checkout", "cart", "subscribe", "unsubscribe", "edit", "vote", "purchase"]
ASSETS = ["css", "js", "mjs", "map", "woff", "woff2", "ttf", "otf", "eot", "ico", "mp4", "webm", "avi", "mov", "mp3", "zip", "exe", "dmg"]
TRACKERS = ["google-analytics.com", "googletagmanager.com", "doubleclick.net", "facebook.net", "hotjar.com"]


# --- fields -----------------------------------------------------------------------------------


def field_bm25(docs: DataFrame, queries: DataFrame, fields: dict[str, str], id_col: str = "doc_id") -> DataFrame:
    """query_id, doc_id, score, phrase: BM25 over weighted fields, as share of each query's best.

    `fields` maps a column to its kind in FIELD_WEIGHTS. A term's frequency and a document's length are weighted sums over the fields, saturated once.
    `phrase` tells whether a field holds all of the query's tokens in order, one after another. Only postings of query terms are exchanged; null fields are empty.
    """
    terms = query_terms(queries)
    known = terms.select("term").distinct()
    words = docs.select(id_col, F.explode(F.array(*[F.struct(F.lit(FIELD_WEIGHTS[kind]).alias("weight"), raw_words(F.col(name)).alias("words")) for name, kind in fields.items()])).alias("f"))
    words = words.select(id_col, F.col("f.weight").alias("weight"), F.explode("f.words").alias("w")).where(is_term(F.col("w"))).select(id_col, "weight", stem(F.col("w")).alias("term"))
    hits = words.join(known, "term", "left_semi").groupBy("term", id_col).agg(F.sum("weight").alias("tf"))
    length = sum((token_count(F.col(name)) * F.lit(FIELD_WEIGHTS[kind]) for name, kind in fields.items()), F.lit(0.0))
    lengths = docs.select(id_col, length.alias("len"))
    corpus = lengths.agg(F.count("*").cast("double").alias("n"), F.coalesce(F.avg("len"), F.lit(1.0)).alias("mean"))
    weights = terms.join(hits.groupBy("term").agg(F.count("*").cast("double").alias("df")), "term")
    part = F.col("qtf") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("len"), F.col("mean"))
    rows = hits.join(weights, "term").join(lengths, id_col).join(F.broadcast(corpus))  # one row
    raw = rows.groupBy("query_id", id_col).agg(F.sum(part).alias("raw"))
    best = raw.groupBy("query_id").agg(F.max("raw").alias("best"))
    joined = lambda c: F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(c, F.lit(""))), " "), F.lit(" "))
    whole = queries.select("query_id", joined(F.col("query")).alias("__q"))
    shown = docs.select(id_col, F.array(*[joined(F.col(name)) for name in fields]).alias("__t"))
    scored = raw.join(best, "query_id").join(whole, "query_id").join(shown, id_col)
    return scored.select("query_id", id_col, (F.col("raw") / F.col("best")).alias("score"), F.exists("__t", lambda t: F.contains(t, F.col("__q"))).alias("phrase"))


def title_match(title: Column, query: Column) -> Column:
    """Share of the query's distinct tokens that the title has; 0 without either."""
    asked = F.array_distinct(tokens(query))
    hits = F.size(F.array_intersect(F.array_distinct(tokens(F.coalesce(title, F.lit("")))), asked))
    return F.when(F.size(asked) > 0, hits / F.size(asked).cast("double")).otherwise(F.lit(0.0))


def is_boilerplate(url: Column) -> Column:
    """One of the path's segments is a name that sites give to pages about themselves."""
    return F.exists(F.split(F.lower(U.path(url)), r"[/.]"), lambda s: s.isin(BOILERPLATE))


def adjusted_scores(rows: DataFrame, query: Column, order: list, url_col: str = "url", title_col: str = "title", scope: list | None = None) -> DataFrame:
    """`rows` with `score` raised by its title and lowered for boilerplate pages and for later rows of one normalised URL; within [0, 1]."""
    url = F.col(url_col)
    key = rows.withColumn("__key", F.coalesce(U.normalise(url), url))
    later = F.row_number().over(W.partitionBy(*(scope or []), "__key").orderBy(*order)) > 1
    made = F.col("score") + title_match(F.col(title_col), query) * F.lit(TITLE_WEIGHT) - F.when(is_boilerplate(url), BOILERPLATE_PENALTY).otherwise(0.0) - F.when(F.col("__later"), DUPLICATE_PENALTY).otherwise(0.0)
    return key.withColumn("__later", later).withColumn("score", F.least(F.greatest(made, F.lit(0.0)), F.lit(1.0))).drop("__key", "__later")


# --- sites ------------------------------------------------------------------------------------


def site(url: Column) -> Column:
    """The registrable site by its last labels: two, or three below SECOND_LEVEL; addresses and single labels stand for themselves."""
    name = U.host(url)
    two = F.substring_index(name, ".", -2)
    return F.when(F.regexp_like(name, F.lit(r"^[0-9.]+$|:")), name).when(two.isin(SECOND_LEVEL), F.substring_index(name, ".", -3)).otherwise(two)


def site_relation(url: Column, base: Column, allowed: list[str] | None = None) -> Column:
    """same_origin, same_site, allowed or external; null for what isn't http(s). `allowed` lists domains that count with their subdomains."""
    name = F.concat(F.lit("."), U.host(url))
    listed = F.lit(False)
    for domain in allowed or []:
        listed |= F.endswith(name, F.lit("." + domain.lower()))
    found = F.when(U.origin(url) == U.origin(base), "same_origin").when(site(url) == site(base), "same_site").when(listed, "allowed").otherwise("external")
    return F.when(U.is_http(url), found)


def diverse_sites(rows: DataFrame, scope: str = "query_id", url_col: str = "url", ties: tuple = ("pos",), limit: int = 10, per_site: int = PER_SITE) -> DataFrame:
    """The `limit` best of each scope when every site gives at most `per_site`; `rank` tells their order."""
    order = [F.col("score").desc(), *ties]
    own = F.row_number().over(W.partitionBy(scope, "__site").orderBy(*order))
    kept = rows.withColumn("__site", F.coalesce(site(F.col(url_col)), F.lit(""))).withColumn("__own", own).where(F.col("__own") <= per_site)
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where(F.col("rank") <= limit).drop("__site", "__own")


# --- evidence ---------------------------------------------------------------------------------


def agreement(claims: DataFrame, keys: list[str], source: str = "source", value: str = "value") -> DataFrame:
    """keys, n_sources, n_values, agreement of each claim: `mixed` with several values, else `agreed` with several sources, else `single`; `none` without values.

    No value is called the right one. Null values don't count. Distinct (source, value) pairs meet after partial aggregation.
    """
    pairs = claims.select(*keys, source, value).distinct().groupBy(*keys)
    told = F.col(value).isNotNull()
    counted = pairs.agg(F.count_distinct(F.when(told, F.col(source))).alias("n_sources"), F.count_distinct(value).alias("n_values"))
    kind = F.when(F.col("n_values") == 0, "none").when(F.col("n_values") > 1, "mixed").when(F.col("n_sources") > 1, "agreed").otherwise("single")
    return counted.withColumn("agreement", kind)


def http_date(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("dd MMM yyyy HH:mm:ss"))


def freshness(modified: Column, published: Column, feed: Column, lastmod: Column, header: Column) -> Column:
    """struct<at, signal>: the first readable of article modification, publication, feed date, sitemap date and Last-Modified; both null without any."""
    named = [("article_modified", parse_time(modified)), ("article_published", parse_time(published)), ("feed", F.coalesce(parse_time(feed), http_date(feed))), ("sitemap", parse_time(lastmod)), ("last_modified", http_date(header))]
    signal = F.lit(None).cast("string")
    for name, at in reversed(named):
        signal = F.when(at.isNotNull(), name).otherwise(signal)
    return F.struct(F.coalesce(*[at for _, at in named]).alias("at"), signal.alias("signal"))


def provenance(text: Column, section: Column, title: Column) -> Column:
    """struct<page, json_path, title> of a passage: the page a section names, the path its first line starts with, the source's title if not blank."""
    page = F.regexp_extract(F.coalesce(section, F.lit("")), r"^Page (\d+)$", 1).try_cast("int")
    path = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\[([^\]\n]+(?:\[\d+\][^\]\n]*)*)\] ", 1), F.lit(""))
    return F.struct(page.alias("page"), path.alias("json_path"), F.nullif(F.trim(title), F.lit("")).alias("title"))


# --- what to fetch ----------------------------------------------------------------------------


def meta_content(html: Column, name: str) -> Column:
    """Content of the first meta element of a name, by pattern; empty without one."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), rf"""(?is)<meta\s+name=["']?{name}["']?\s+content=["']([^"']*)["']""", 1)


def directives(html: Column, header: Column) -> Column:
    """struct<noindex, nofollow, noarchive, nosnippet> of a robots meta element and X-Robots-Tag together; `none` stands for the first two."""
    said = F.split(F.lower(F.concat_ws(",", meta_content(html, "robots"), header)), r"[,\s]+")
    has = lambda *names: F.arrays_overlap(said, F.array(*[F.lit(n) for n in names]))
    return F.struct(has("noindex", "none").alias("noindex"), has("nofollow", "none").alias("nofollow"), has("noarchive").alias("noarchive"), has("nosnippet").alias("nosnippet"))


def skip_reason(url: Column) -> Column:
    """Why a link isn't followed: action (may change state), asset, tracker; null for a candidate."""
    words = F.split(F.lower(F.concat(U.path(url), F.lit("?"), U.query(url))), "[^a-z0-9]+")
    name = F.concat(F.lit("."), U.host(url))
    tracker = F.lit(False)
    for domain in TRACKERS:
        tracker |= F.endswith(name, F.lit("." + domain))
    return F.when(F.exists(words, lambda w: w.isin(ACTIONS)), "action").when(U.extension(U.path(url)).isin(ASSETS), "asset").when(tracker, "tracker")


# Elements and the attribute that holds their URL.
LINK_KINDS = [("a", "href"), ("link", "href"), ("img", "src"), ("iframe", "src"), ("script", "src"), ("source", "src"), ("form", "action")]


def resource_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id, kind, pos, href of all elements that name a resource, by pattern; pos counts within the kind. Only kind `a` and what a caller picks are candidates."""

    def found(tag: str, attribute: str) -> Column:
        hrefs = F.regexp_extract_all(html_col, F.lit(rf"""(?is)<{tag}\b[^>]*?\s{attribute}\s*=\s*["']([^"']*)["']"""), F.lit(1))
        return F.transform(hrefs, lambda h, i: F.struct(F.lit(tag).alias("kind"), i.cast("long").alias("pos"), h.alias("href")))

    kinds = [found(tag, attribute) for tag, attribute in LINK_KINDS]
    return pages.select(id_col, F.explode(F.concat(*kinds)).alias("l")).select(id_col, "l.kind", "l.pos", "l.href").where("href <> ''")


def status_action(status: Column) -> Column:
    """parse, empty, redirect, use_cache, blocked, resolve, retry, backoff, temporary_failure, failure; null status is a failure."""
    return (
        F.when(status == 204, "empty").when((status >= 200) & (status < 300), "parse").when(status.isin(301, 302, 303, 307, 308), "redirect").when(status == 304, "use_cache").when(status.isin(401, 403), "blocked")
        .when(status.isin(404, 410), "resolve").when(status == 408, "retry").when(status == 429, "backoff").when(status >= 500, "temporary_failure").otherwise("failure")
    )


def site_index(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` without html, with canonical, title, description, headings, language and content_hash: what later requests need without the bodies. A projection."""
    html = F.col(html_col)
    headings = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)), lambda h: collapse(F.regexp_replace(h, "<[^>]*>", "")))
    canonical = F.regexp_extract(html, r"""(?is)<link\s+rel=["']?canonical["']?\s+href=["']?([^"'\s>]+)""", 1)
    language = F.regexp_extract(html, r"""(?is)<html[^>]*\slang=["']?([A-Za-z-]+)""", 1)
    empty = lambda c: F.nullif(c, F.lit(""))
    rest = [c for c in pages.columns if c != html_col]
    return pages.select(
        *rest, F.coalesce(U.resolve(empty(canonical), F.col(url_col)), F.col(url_col)).alias("canonical"), page_title(html).alias("title"), empty(collapse(meta_content(html, "description"))).alias("description"),
        F.filter(headings, lambda h: h != "").alias("headings"), empty(F.lower(language)).alias("language"), F.sha2(html, 256).alias("content_hash"),
    )


# --- evaluation -------------------------------------------------------------------------------


def evaluation(cases: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cases, url_recall, source_precision, correction_accuracy, false_correction_rate over labelled cases.

    `cases` has asked, expected (null: no page answers) and returned URLs (null: none). A correction is a returned URL that differs from the one asked for;
    it is false if it isn't the expected one. Rates without cases are null. URLs are compared in normalised form.
    """
    norm = lambda name: F.coalesce(U.normalise(F.col(name)), F.col(name))
    rows = cases.select(*keys, norm("asked").alias("a"), norm("expected").alias("e"), norm("returned").alias("r"))
    right, given = F.col("r") == F.col("e"), F.col("r").isNotNull()
    corrected = given & ~F.col("a").eqNullSafe(F.col("r"))
    rate = lambda hits, of: F.count_if(hits) / F.nullif(F.count_if(of), F.lit(0).cast("long"))
    good = F.coalesce(right, F.lit(False))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_cases"), rate(good, F.col("e").isNotNull()).alias("url_recall"), rate(good, given).alias("source_precision"),
        rate(corrected & good, corrected).alias("correction_accuracy"), rate(corrected & ~good, corrected).alias("false_correction_rate"),
    )
