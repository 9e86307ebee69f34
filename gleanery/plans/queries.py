"""The registered queries of the retrieval engine: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import mime as M
from ..functions import planning as P
from ..functions import text as T
from ..functions import url as U
from ..operators import bm25 as B
from ..operators import candidates as C
from ..operators import evidence as E
from ..operators import policy as R
from ..sources import formats as S
from ..sources import schemas
from ..streaming.pages import cache_live, cacheable
from ..streaming.pages import cached_fetches as replayed
from . import derived
from . import fixtures as X
from . import signals
from .retrieve import Engine, best_result, function_answer, message_text, rpc_reply, text_block


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(spark) -> DataFrame:
    return X.frame(spark, [(1, X.QUERY)], "query_id long, query string")


def tokenize_terms(spark, sf_dir):
    return T.term_rows(table(spark, sf_dir, "documents")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def term_df(spark, sf_dir):
    return tokenize_terms(spark, sf_dir).groupBy("term").agg(F.count("*").alias("df"))


def bm25_corpus(spark, sf_dir):
    top = B.top_documents(table(spark, sf_dir, "documents"), _query(spark))
    return top.select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _passages(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").withColumn("query", F.lit(X.QUERY))
    return B.passages(docs)


def bm25_passages(spark, sf_dir):
    return _passages(spark, sf_dir).select("doc_id", "window_no", "char_offset", F.round("relevance", 6).alias("relevance"))


def passage_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("window_no", "w"))
    return rows.select("doc_id", "window_no", "w.char_offset", "w.text")


def dedupe_passages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return E.dedupe_passages(docs, ["doc_id"], scope=None).select("doc_id")


def _evidence(spark, sf_dir) -> DataFrame:
    rows = _passages(spark, sf_dir).withColumn("query_id", F.lit(1).cast("long"))
    kept = E.dedupe_passages(rows, ["doc_id", "window_no"])
    kept = kept.withColumn("relevance", F.round("relevance", 6))
    return E.top_evidence(kept, source="source", ties=("doc_id", "window_no"))


def evidence_top10_diverse(spark, sf_dir):
    return _evidence(spark, sf_dir).select("rank", "doc_id", "window_no", "source", "relevance")


def source_relevance(spark, sf_dir):
    sources = table(spark, sf_dir, "documents").select(F.lit(1).cast("long").alias("query_id"), F.col("source").alias("url")).distinct()
    rows = _passages(spark, sf_dir).groupBy("source").agg(F.max("relevance").alias("relevance")).select(F.lit(1).cast("long").alias("query_id"), F.col("source").alias("source_url"), "relevance")
    return E.source_relevance(sources, rows).select("url", F.round("relevance", 6).alias("relevance"))


def _status() -> F.Column:
    return F.element_at(F.array(F.lit(200), F.lit(404), F.lit(301), F.lit(503)), (F.col("page_id") % 4 + 1).cast("int"))


def score_source(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", F.round(E.source_score(_status(), S.page_title(F.col("html"))), 6).alias("score"))


def normalise_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url")).alias("normalised"))


def dedupe_urls(spark, sf_dir):
    return E.dedupe_urls(table(spark, sf_dir, "pages").select("page_id", "url"), ["page_id"]).select("page_id", "url")


def url_origin_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("n"))


def url_depth(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.depth(F.col("url")).alias("depth"))


def _scored(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    score = C.url_score(F.col("url"), F.lit("english thing 825 example"), F.lit("https://www.spam-farm.example.org/"), F.lit(X.AS_OF))
    return pages.withColumn("score", F.round(score, 6))


def url_score(spark, sf_dir):
    return _scored(spark, sf_dir).select("page_id", "score")


def recency_score(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("lastmod"))
    return orders.select("o_orderkey", F.round(C.recency(F.col("lastmod"), F.lit(X.AS_OF)), 6).alias("score"))


def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.page_title(F.col("html")).alias("title"))


def page_links(spark, sf_dir):
    return S.page_links(table(spark, sf_dir, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "anchor_text")


def same_origin_links(spark, sf_dir):
    return S.same_origin_links(S.page_links(table(spark, sf_dir, "pages"))).select("page_id", "link", "anchor_text")


def anchor_overlap(spark, sf_dir):
    links = S.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", F.col("pos").cast("long").alias("pos"), F.round(C.anchor_overlap(F.col("anchor_text"), F.lit(X.QUERY)), 6).alias("overlap"))


def candidate_rank(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("query_id", U.origin(F.col("url")))
    return C.rank_candidates(rows, F.lit(5), order=("page_id",)).select(F.col("query_id").alias("origin"), "rank", "page_id", "score")


def _visits(spark, sf_dir) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", rank.alias("rank"))


def stop_prefix(spark, sf_dir):
    rows = _visits(spark, sf_dir).withColumn("mode", F.lit("deep")).withColumn("n_good", (F.col("doc_id") % 3 == 0).cast("long"))
    return E.stop_prefix(rows, scope="source").select("source", "doc_id", "rank", "good_before")


def budget_cut(spark, sf_dir):
    rows = _visits(spark, sf_dir).withColumn("cost", F.col("doc_id") % 3 + 1)
    return E.budget_cut(rows, F.lit(16), scope="source").select("source", "doc_id", "used")


def url_repair(spark, sf_dir):
    asked = X.frame(spark, X.ASKED, "query_id long, url string, canonical string")
    return C.repair_urls(asked, X.frame(spark, X.OBSERVED, "url string, pos long, anchor_text string, priority double"))


def path_similarity(spark, sf_dir):
    links = S.same_origin_links(S.page_links(table(spark, sf_dir, "pages")))
    return links.select("page_id", "link", F.round(C.path_similarity(U.path(F.col("url")), U.path(F.col("link"))), 6).alias("similarity"))


def infer_mode(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    rows = turns.unionByName(X.frame(spark, [(-i, 0, q) for i, q in X.QUERIES], "conv_id long, turn long, query string"))
    return rows.select("conv_id", "turn", P.infer_mode(F.col("query")).alias("mode"))


def resolve_budget(spark, sf_dir):
    rows = X.frame(spark, X.QUERIES, "query_id long, query string").withColumn("mode", P.infer_mode(F.col("query")))
    given = F.when(F.col("query_id") == 2, 9).cast("int")
    return rows.select("query_id", "mode", P.max_pages(F.col("mode"), given).alias("max_pages"), P.max_requests(F.col("mode")).alias("max_internal_requests"))


def expand_tokens(spark, sf_dir):
    rows = X.frame(spark, X.QUERIES, "query_id long, query string")
    return rows.select("query_id", F.explode(P.expand_tokens(F.col("query"))).alias("token"))


def robots_groups(spark, sf_dir):
    groups = R.robots_groups(X.frame(spark, X.ROBOTS, schemas.ROBOTS))
    return groups.select("origin", F.col("group_no").cast("long").alias("group_no"), F.array_join("agents", ",").alias("agents"), F.size("rules").alias("n_rules"), "crawl_delay")


def robots_allowed(spark, sf_dir):
    return R.robots_allowed(X.frame(spark, X.ROBOT_URLS, "url string"), X.frame(spark, X.ROBOTS, schemas.ROBOTS))


def ssrf_ipv4(spark, sf_dir):
    return R.ssrf(X.frame(spark, X.URLS, "id long, url string"), X.frame(spark, X.DNS, schemas.DNS)).select("id", "ssrf_blocked")


def ssrf_ipv6(spark, sf_dir):
    return X.frame(spark, X.IPV6, "ip string").select("ip", R.blocked_ip(F.col("ip")).alias("blocked"))


def safe_port(spark, sf_dir):
    return X.frame(spark, X.PORTS, "port int").select("port", U.safe_port(F.col("port")).alias("safe"))


def url_error(spark, sf_dir):
    return X.frame(spark, X.URLS, "id long, url string").select("id", U.url_error(F.col("url")).alias("error"))


def domain_policy(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    allow, deny = X.frame(spark, ["example.com", "example.org"], "domain string"), X.frame(spark, ["spam-farm.example.org", "www.cheap-pills.example.com"], "domain string")
    return R.domain_policy(pages, allow, deny).select("page_id")


def redirect_chain(spark, sf_dir):
    starts = X.frame(spark, ["http://a.com/1", "http://loop.com/x", "http://long.com/0", "http://long.com/1", "http://private.com/", "http://scheme.com/", "http://none.com/"], "url string")
    return R.redirect_chain(starts, X.frame(spark, X.REDIRECTS, schemas.REDIRECTS))


def retry_delay(spark, sf_dir):
    rows = X.frame(spark, X.RETRIES, "id long, retry_after string, attempt int")
    return rows.select("id", P.retry_delay_ms(F.col("retry_after"), F.col("attempt"), F.lit(X.AS_OF)).alias("delay_ms"))


def mime_detect(spark, sf_dir):
    return X.frame(spark, X.BODIES, "id long, header string, body binary").select("id", M.detect(F.col("header"), F.col("body")).alias("mime"))


def json_flatten(spark, sf_dir):
    return S.flat_json_rows(table(spark, sf_dir, "events"), "event_id", "props")


def json_paths(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("body"))
    return S.extract_json(events).select("event_id", F.col("extracted.text").alias("text"))


def bare_url_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see "), "url", F.lit(" and ("), "url", F.lit(")")).alias("body"))
    return rows.select("page_id", F.explode(T.bare_links(T.plain_text(F.col("body")))).alias("link"))


def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


def sitemap_entries(spark, sf_dir):
    rows = S.sitemap_entries(X.frame(spark, X.SITEMAPS, "url string, body string"))
    return rows.select("url", "loc", "lastmod", "priority")


def sitemap_discovery(spark, sf_dir):
    origins = X.frame(spark, ["https://a.com"], "origin string")
    declared = R.robots_sitemaps(X.frame(spark, X.ROBOTS, schemas.ROBOTS)).select("origin", "url")
    return S.discover_sitemaps(origins, declared, X.frame(spark, X.SITEMAPS, "url string, body string")).select("origin", "url", F.col("pos").cast("long").alias("pos"))


def feed_items(spark, sf_dir):
    return S.feed_items(X.frame(spark, X.FEEDS, "url string, body string")).select("url", F.col("pos").cast("long").alias("pos"), "title", "date", "summary", "link")


def _engine(spark, sf_dir) -> tuple[Engine, DataFrame]:
    pages = table(spark, sf_dir, "pages")
    fetched = pages.select("url", F.lit(200).alias("status"), F.create_map(F.lit("content-type"), F.lit("text/html")).alias("headers"), F.encode("html", "UTF-8").alias("body"))
    requests = pages.select(F.col("page_id").alias("query_id"), F.lit(0).alias("pos"), "url", F.lit(X.QUERY).alias("query"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("int").alias("max_pages"), F.lit(None).cast("int").alias("max_internal_requests"), F.lit(X.AS_OF).alias("as_of"))
    return Engine(spark, fetched), requests


def retrieve_results(spark, sf_dir):
    engine, requests = _engine(spark, sf_dir)
    rows = engine.retrieve(requests)
    return rows.select("query_id", "status", "navigation.method", F.size(F.coalesce("sources", F.array())).alias("n_sources"), F.size(F.coalesce("evidence", F.array())).alias("n_evidence"))


def tool_text(spark, sf_dir):
    engine, requests = _engine(spark, sf_dir)
    return text_block(engine.retrieve(requests))


def best_call_result(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tool_call_id"), F.col("turn").alias("pos"), F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "success").otherwise("not_found").alias("status"), F.array_repeat(F.lit(1), (F.col("turn") % 3).cast("int")).alias("evidence"))
    return best_result(turns).select("tool_call_id", "pos", "status")


def cache_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("value"), F.col("ts").alias("stored_at"), F.lit(86_400 * 30).alias("ttl_seconds"))
    newest = events.agg(F.max("stored_at")).first()[0]
    return cache_live(events, F.lit(str(newest)).cast(events.schema["stored_at"].dataType)).select("key", "stored_at")


def cached_fetches(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 5 == 0, 404).otherwise(200)
    size = F.col("event_id") % 7 * 400_000
    log = events.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), "ts", cacheable(status, F.lit("text/html"), size, M.HTML_LIMIT).alias("cacheable"))
    return replayed(log, 86_400).select("request_id", "hit")


def _answers(spark, sf_dir):
    """Results made of conversations: a turn's text is the evidence, six times over where the conversation's number is even."""
    key, turn = F.col("conv_id"), F.col("turn")
    asked = F.concat(F.lit("https://a.com/"), key.cast("string"))
    item = lambda i: F.struct(i.alias("rank"), F.concat(asked, F.lit("/"), i.cast("string")).alias("source_url"), F.col("text").alias("text"), F.lit("Part").alias("section"), (i / F.lit(8.0)).alias("relevance"))
    evidence = F.when(turn % 3 == 0, F.array().cast("array<struct<rank:int,source_url:string,text:string,section:string,relevance:double>>")).otherwise(F.transform(F.sequence(F.lit(1), F.when(key % 2 == 0, 6).otherwise(1)), item))
    there = turn % 4 != 0
    nav = F.struct(there.alias("resolved"), F.when(there, "exact").otherwise("none").alias("method"), F.when(there, F.when(turn % 2 == 0, asked).otherwise(F.concat(asked, F.lit("/new")))).alias("resolved_url"), F.when(~there & (key % 2 == 0), "no_safe_url_match").alias("reason"))
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    status = F.when(F.size(evidence) > 0, "success").otherwise("not_found")
    return rows.select((key * 100 + turn).alias("query_id"), asked.alias("url"), F.lit(X.QUERY).alias("query"), status.alias("status"), nav.alias("navigation"), F.transform(evidence, lambda e: e["source_url"]).alias("sources"), evidence.alias("evidence"))


def answer_message(spark, sf_dir):
    return message_text(_answers(spark, sf_dir))


def answer_function(spark, sf_dir):
    return function_answer(_answers(spark, sf_dir))


def answer_rpc(spark, sf_dir):
    return rpc_reply(_answers(spark, sf_dir).select("query_id", "status", "query"))


def host_gap(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("event_type").alias("host"), "ts")
    return R.host_gaps(log).select("request_id", "gap_ms", "too_soon")


NAMES = [
    "tokenize_terms", "term_df", "bm25_corpus", "bm25_passages", "passage_windows", "dedupe_passages", "evidence_top10_diverse", "source_relevance", "score_source", "normalise_url", "dedupe_urls", "url_origin_counts",
    "url_depth", "url_score", "recency_score", "page_title", "page_links", "same_origin_links", "anchor_overlap", "candidate_rank", "stop_prefix", "budget_cut", "path_similarity", "infer_mode", "domain_policy",
    "json_flatten", "json_paths", "bare_url_links", "strip_tags", "retrieve_results", "tool_text", "best_call_result", "cache_ttl", "host_gap",
    "cached_fetches", "answer_message", "answer_function", "answer_rpc",
]


INLINE = ["url_repair", "resolve_budget", "expand_tokens", "robots_allowed", "robots_groups", "ssrf_ipv4", "ssrf_ipv6", "safe_port", "url_error", "redirect_chain", "retry_delay", "mime_detect", "sitemap_entries", "sitemap_discovery", "feed_items"]


def queries() -> dict:
    return {name: globals()[name] for name in NAMES} | derived.queries() | signals.queries()
