"""Evidence retrieval as one plan over tables: requests and fetched pages in, ranked evidence out.

Each stage is a DataFrame keyed by query_id; pages are parsed once for all requests. Nothing is collected; every join is an
equi-join on a URL, an origin or a query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import planning as P
from ..functions import url as U
from ..functions.mime import HTML_LIMIT, PDF_LIMIT, body_error
from ..operators import policy
from ..operators.bm25 import passages
from ..operators.candidates import match_score, rank_candidates, repair_urls, url_score
from ..operators.evidence import budget_cut, dedupe_passages, source_relevance, source_score, stop_prefix, top_evidence
from ..sources import schemas
from ..sources.formats import discover_sitemaps, extract_documents, with_mime
from .storage import keep

SOURCES = "array<struct<rank:int,url:string,title:string,type:string,relevance:double,http_status:int>>"


@dataclass
class Engine:
    """Tables and hooks of a retrieval session.

    `hints` (name, url) resolves bare names; `extractors` maps content types to readers; `rank` replaces the ranking of candidates
    (a frame with query_id, url, score, pos in and out); `discovered` (query_id, url, title, snippet) adds candidates from elsewhere;
    `redirects` (from_url, to_url) is followed under policy. Every URL that is asked for, redirected to or a candidate passes the
    same checks. Bodies beyond html_limit bytes (pdf_limit with enable_pdf) aren't read; other types' are cut at html_limit.
    """

    spark: SparkSession
    fetched: DataFrame
    robots: DataFrame | None = None
    dns: DataFrame | None = None
    hints: DataFrame | None = None
    allow: DataFrame | None = None
    deny: DataFrame | None = None
    discovered: DataFrame | None = None
    redirects: DataFrame | None = None
    html_limit: int = HTML_LIMIT
    pdf_limit: int = PDF_LIMIT
    enable_pdf: bool = False
    rank: Callable[[DataFrame], DataFrame] | None = None
    extractors: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def _table(self, given: DataFrame | None, schema: str) -> DataFrame:
        return given if given is not None else self.spark.createDataFrame([], schema)

    def plan(self, requests: DataFrame) -> DataFrame:
        """Requests with hinted URL, mode, budgets and error."""
        hints = self._table(self.hints, "name string, url string").select(F.lower("name").alias("__name"), F.col("url").alias("__hint"))
        bare = F.when(~F.contains("url", F.lit(".")) & ~F.startswith("url", F.lit("http")), F.lower(F.trim("url")))
        rows = requests.withColumn("__bare", bare).join(hints, F.col("__bare") == F.col("__name"), "left").withColumn("url", F.coalesce("__hint", "url")).drop("__bare", "__name", "__hint")
        rows = rows.withColumn("mode", F.coalesce("mode", P.infer_mode(F.col("query"))))
        rows = rows.withColumn("max_pages", P.max_pages(F.col("mode"), F.col("max_pages"))).withColumn("max_internal_requests", P.max_requests(F.col("mode"), F.col("max_internal_requests")))
        return self.checked(rows).withColumn("norm", U.normalise(F.col("url"))).withColumn("origin", U.origin(F.col("url")))

    def checked(self, urls: DataFrame) -> DataFrame:
        """`urls` with the error that forbids fetching each, if any; a URL is judged once."""
        verdicts = policy.visitable(urls.select("url").distinct(), self.robots, self.dns, self.allow, self.deny)
        return urls.join(keep(verdicts).withColumnRenamed("url", "__url"), F.col("url").eqNullSafe(F.col("__url"))).drop("__url")

    def documents(self) -> DataFrame:
        """One extracted document per normalised URL of `fetched`, 200 answers first, and per URL that redirects to one; fetch_error tells why one can't be had."""
        keyed = self.fetched.withColumn("norm", U.normalise(F.col("url"))).where("norm IS NOT NULL")
        one = keyed.groupBy("norm").agg(F.min_by(F.struct("url", "status", "headers", "body"), F.struct((F.col("status") != 200).alias("bad"), F.col("url").alias("u"))).alias("r")).select("norm", "r.*")
        declared = F.try_element_at("headers", F.lit("content-length")).try_cast("bigint")
        limit = max(self.html_limit, self.pdf_limit) if self.enable_pdf else self.html_limit
        sized = with_mime(one.withColumn("fetch_error", body_error(F.col("body"), declared, limit)).withColumn("body", F.when(F.col("fetch_error").isNull(), F.col("body"))))
        cut = F.when((F.col("mime") != "application/pdf") & (F.octet_length("body") > self.html_limit), F.decode(F.substring("body", 1, self.html_limit), "UTF-8")).otherwise(F.col("body_text"))
        typed = keep(sized.select("norm", "url", "status", "mime", "fetch_error", cut.alias("body_text")))  # the type is told once for all readers
        found = extract_documents(typed, extra=self.extractors).select("norm", F.col("url").alias("final_url"), "status", "mime", "extracted", "fetch_error")
        if self.redirects is None:
            return found
        found = keep(found)
        chains = policy.redirect_chain(self.redirects.select(F.col("from_url").alias("url")).distinct(), self.redirects)
        chains = chains.withColumn("start", U.normalise(F.col("url"))).where("start IS NOT NULL AND (hops > 0 OR error IS NOT NULL)").withColumnRenamed("error", "broken")
        chains = self.checked(chains.drop("url").withColumnRenamed("final_url", "url")).withColumn("norm", U.normalise(F.col("url")))
        # What a broken chain is called as an error of a request.
        name = F.when(F.col("broken") == "LOOP", "REDIRECT_LOOP").otherwise(F.col("broken"))
        chains = chains.groupBy("start").agg(F.min(F.struct("url", "norm", F.coalesce(name, "error").alias("why"))).alias("c")).select("start", F.col("c.norm").alias("norm"), F.col("c.url").alias("end"), F.col("c.why").alias("why"))
        moved = chains.join(found, "norm", "left").select(F.col("start").alias("norm"), F.coalesce("final_url", "end").alias("final_url"), F.when(F.col("why").isNull(), F.col("status")).alias("status"), "mime", F.when(F.col("why").isNull(), F.col("extracted")).alias("extracted"), F.coalesce("why", "fetch_error").alias("fetch_error"))
        return found.join(chains.select(F.col("start").alias("norm")), "norm", "left_anti").unionByName(moved)

    def observed(self, plan: DataFrame, documents: DataFrame) -> DataFrame:
        """query_id, url, anchor_text, lastmod, priority, pos: sitemap entries of the request's origin, then the root page's links."""
        origins = plan.where("error IS NULL").select("origin").distinct()
        robots = self._table(self.robots, "origin string, status int, text string")
        declared = policy.robots_sitemaps(robots).select("origin", "url").join(origins, "origin", "left_semi")
        files = self.fetched.where("status = 200").select("url", F.decode("body", "UTF-8").alias("body"))
        entries = discover_sitemaps(origins, declared, files)
        null = F.lit(None)
        mapped = plan.join(entries.select("origin", F.col("url").alias("seen"), "lastmod", "priority", F.col("pos").alias("at")), "origin").select("query_id", F.col("seen").alias("url"), null.cast("string").alias("anchor_text"), "lastmod", "priority", F.col("at").cast("long").alias("pos"))
        root = plan.join(documents, "norm").select("query_id", F.posexplode("extracted.links").alias("at", "link"))
        linked = root.select("query_id", F.col("link.url").alias("url"), F.col("link.anchor_text").alias("anchor_text"), null.cast("string").alias("lastmod"), null.cast("double").alias("priority"), (F.col("at") + F.lit(1_000_000)).cast("long").alias("pos"))
        rows = mapped.unionByName(linked)
        if self.discovered is not None:
            rows = rows.unionByName(self.discovered.select("query_id", "url", F.col("title").alias("anchor_text"), null.cast("string").alias("lastmod"), null.cast("double").alias("priority"), F.lit(2_000_000).cast("long").alias("pos")))
        keyed = rows.withColumn("norm", U.normalise(F.col("url"))).where("norm IS NOT NULL")
        return keyed.groupBy("query_id", "norm").agg(F.min_by(F.struct("url", "anchor_text", "lastmod", "priority", "pos"), "pos").alias("r")).select("query_id", "norm", "r.*")

    def navigation(self, plan: DataFrame, documents: DataFrame, observed: DataFrame) -> DataFrame:
        """query_id, resolved, method, resolved_url, target: exact or redirect where the root answered 200, else repair among the
        observed URLs of the request's origin."""
        root = plan.select("query_id", "url", "norm", "origin", "error").join(documents.select("norm", "final_url", "status", "fetch_error"), "norm", "left").withColumn("error", F.coalesce("error", "fetch_error"))
        seen = observed.select("query_id", F.col("url").alias("seen"), F.col("norm").alias("seen_norm"), "anchor_text", "priority", "pos")
        lost = root.where("error IS NULL AND coalesce(status, 0) <> 200").select("query_id", "url", "origin")
        scored = lost.join(seen, "query_id").where(U.origin(F.col("seen")) == F.col("origin"))
        scored = scored.withColumn("score", match_score(F.col("url"), F.col("seen"), F.col("anchor_text"), F.col("priority"))).where("score >= 0.6")
        best = scored.groupBy("query_id").agg(F.max_by(F.struct("seen", "seen_norm"), F.struct("score", -F.col("pos"))).alias("best"))
        rows = root.join(best, "query_id", "left")
        good = F.col("status") == 200
        method = F.when(F.col("error").isNotNull(), "none").when(good & (U.normalise(F.col("final_url")) != F.col("norm")), "redirect").when(good, "exact").when(F.col("best").isNotNull(), "path_similarity").otherwise("none")
        resolved = F.when(F.col("error").isNull(), F.when(good, F.col("final_url")).otherwise(F.col("best.seen")))
        target = F.when(F.col("error").isNull(), F.when(good, F.col("norm")).otherwise(F.col("best.seen_norm")))
        return rows.select("query_id", resolved.isNotNull().alias("resolved"), method.alias("method"), resolved.alias("resolved_url"), target.alias("target"), F.when(resolved.isNull() & F.col("error").isNull(), "no_safe_url_match").alias("reason"), F.col("fetch_error"))

    def evidence(self, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """plan, navigation, sources, evidence and counts."""
        # stages that several later ones read are kept: pages are parsed once, and plans stay small
        plan = keep(self.plan(requests))
        documents = keep(self.documents())
        observed = keep(self.observed(plan, documents))
        nav = keep(self.navigation(plan, documents, observed))
        asked = plan.where("error IS NULL").select("query_id", F.col("url").alias("base"), "query", "mode", "max_pages", "max_internal_requests", "as_of")
        root = asked.join(nav.where("resolved").select("query_id", F.col("target").alias("norm")), "query_id").withColumn("rank", F.lit(0))
        others = asked.join(observed, "query_id").join(root.select("query_id", F.col("norm").alias("__root")), "query_id", "left").where("__root IS NULL OR norm <> __root")
        considered = others.groupBy("query_id").agg(F.count("*").alias("candidates_considered"))
        others = self.checked(others).where("error IS NULL").drop("error")
        score = url_score(F.col("url"), F.col("query"), F.col("base"), F.col("as_of"), F.col("anchor_text"), None, F.col("lastmod"), F.col("priority"))
        ranked = others.withColumn("score", score)
        ranked = rank_candidates(self.rank(ranked) if self.rank else ranked, F.col("max_pages") - 1)
        columns = ["query_id", "query", "mode", "max_internal_requests", "norm", "rank"]
        ranked = keep(ranked)
        visits = budget_cut(root.select(*columns).unionByName(ranked.select(*columns)).withColumn("cost", F.lit(1)), F.col("max_internal_requests"))
        pages = visits.join(documents.where("status = 200"), "norm")
        found = keep(passages(pages.select("query_id", "norm", "rank", "query", F.col("extracted.text").alias("text"))))
        tried = visits.groupBy("query_id").agg(F.count("*").alias("http_requests"))
        wanted = ranked.groupBy("query_id").agg(F.count("*").alias("kept"))
        counts = asked.select("query_id").join(considered, "query_id", "left").join(tried, "query_id", "left").join(wanted, "query_id", "left").na.fill(0)
        dropped, short = F.col("candidates_considered") - F.col("kept"), F.col("http_requests") < F.col("kept")
        counts = counts.select("query_id", "http_requests", "candidates_considered", dropped.alias("candidates_dropped"), short.alias("budget_exhausted"))
        good = found.groupBy("query_id", "norm").agg(F.count_if(F.col("relevance") >= P.GOOD).alias("n_good"))
        kept = stop_prefix(pages.join(good, ["query_id", "norm"], "left").withColumn("n_good", F.coalesce("n_good", F.lit(0))))
        sources = kept.select("query_id", "norm", "rank", F.col("final_url").alias("url"), F.col("extracted.title").alias("title"), "mime", "status", source_score(F.col("status"), F.col("extracted.title")).alias("score"), F.col("extracted.requires_browser").alias("shell"), F.col("extracted.metadata").alias("metadata"))
        rows = found.join(sources.select("query_id", "norm", F.col("url").alias("source_url")), ["query_id", "norm"]).withColumn("encounter", F.struct("rank", "window_no"))
        fused = top_evidence(dedupe_passages(rows.drop("rank"), ["encounter"]), ties=("encounter",))
        return plan, nav, source_relevance(sources, fused), fused.select("query_id", "rank", "source_url", "text", "section", "relevance"), counts

    def retrieve(self, requests: DataFrame) -> DataFrame:
        """One row per request: query_id, url, query, mode, status, navigation, sources, evidence, diagnostics, error."""
        plan, nav, sources, evidence, counts = self.evidence(requests)
        ev = evidence.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source_url", "text", "section", "relevance"))).alias("evidence"))
        own = sources.groupBy("query_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", "url", "title", F.col("mime").alias("type"), "relevance", F.col("status").alias("http_status")))).alias("sources"),
            F.max(F.when(F.col("rank") == 0, F.col("shell"))).alias("shell"),
            F.max_by("metadata", -F.col("rank")).alias("meta"),
        )
        rows = plan.join(nav, "query_id", "left").join(own, "query_id", "left").join(ev, "query_id", "left").join(counts, "query_id", "left").withColumn("error", F.coalesce("error", "fetch_error"))
        some = F.size(F.coalesce("evidence", F.array())) > 0
        status = F.when(F.col("error").isin("ROBOTS_DISALLOWED", "DOMAIN_DENIED"), "blocked").when(F.col("error").isNotNull(), "failed").when(F.coalesce("shell", F.lit(False)) & ~some, "js_required").when(some, "success").otherwise("not_found")
        return rows.select(
            "query_id", "url", "query", "mode", status.alias("status"), F.struct("resolved", "method", "resolved_url", "reason").alias("navigation"), "sources", "evidence",
            F.struct(
                F.coalesce("http_requests", F.lit(0)).alias("http_requests"), F.size(F.coalesce("sources", F.array())).alias("pages_fetched"), F.size(F.filter(F.coalesce("sources", F.array().cast(SOURCES)), lambda x: x["type"] != "unknown")).alias("documents_parsed"),
                F.coalesce("candidates_considered", F.lit(0)).alias("candidates_considered"), F.coalesce("candidates_dropped", F.lit(0)).alias("candidates_dropped"), F.coalesce("budget_exhausted", F.lit(False)).alias("budget_exhausted"),
                F.col("mode").alias("mode"), F.size(F.coalesce("evidence", F.array())).alias("passages"),
            ).alias("diagnostics"),
            F.when(status == "js_required", F.col("meta")).alias("shell_meta"), "error",
        )


def best_result(results: DataFrame, scope: str = "tool_call_id") -> DataFrame:
    """Of each call's results (pos, status, evidence): the first success, else the one with most evidence, earlier ones first."""
    from pyspark.sql import Window as W

    good = F.col("status") == "success"
    order = [good.desc(), F.when(good, F.col("pos")).asc_nulls_last(), F.size(F.coalesce("evidence", F.array())).desc(), F.col("pos")]
    return results.withColumn("__r", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where("__r = 1").drop("__r")


def url_arguments(urls: F.Column, url: F.Column) -> F.Column:
    """The call's URLs: non-empty strings of the array, else the single URL, else none."""
    listed = F.filter(urls, lambda u: u.isNotNull() & (u != ""))
    return F.when(F.size(F.coalesce(urls, F.array())) > 0, listed).when(F.length(url) > 0, F.array(url)).otherwise(F.array().cast("array<string>"))


def text_block(results: DataFrame) -> DataFrame:
    """query_id, text: a result as a block of text for a tool's answer."""
    titles = F.map_from_entries(F.transform(F.coalesce("sources", F.array().cast(SOURCES)), lambda s: F.struct(s["url"], F.coalesce(s["title"], s["url"]))))
    item = lambda e: F.concat_ws("\n", F.concat(F.lit("\n["), e["source_url"], F.lit("] "), F.coalesce(F.try_element_at(titles, e["source_url"]), e["source_url"])), F.concat(F.lit("Section: "), e["section"]), e["text"], F.concat(F.lit("(relevance: "), F.format_string("%.2f", e["relevance"]), F.lit(")")))
    n = lambda c: F.size(F.coalesce(c, F.array())).cast("string")
    head = F.concat_ws("\n", F.concat(F.lit("STATUS: "), F.upper("status")), F.concat(F.lit("QUERY: "), F.col("query")), F.concat(F.lit("SOURCES FETCHED: "), n("sources")), F.concat(F.lit("EVIDENCE PASSAGES: "), n("evidence")))
    moved = F.when(F.col("navigation.resolved") & (F.col("navigation.resolved_url") != F.col("url")), F.concat(F.lit("URL REPAIRED: "), F.col("url"), F.lit(" → "), F.col("navigation.resolved_url"), F.lit(" (via "), F.col("navigation.method"), F.lit(")")))
    none = F.concat_ws("\n", F.concat(F.lit("\nNo relevant evidence found. Navigation: "), F.coalesce("navigation.method", F.lit("none")), F.lit(" (resolved: "), F.coalesce(F.col("navigation.resolved"), F.lit(False)).cast("string"), F.lit(")")), F.concat(F.lit("Reason: "), F.col("navigation.reason")))
    meta = F.array_join(F.transform(F.map_entries(F.coalesce("shell_meta", F.create_map().cast("map<string,string>"))), lambda x: F.concat(F.lit("  "), x["key"], F.lit(": "), x["value"])), "\n")
    shell = F.concat_ws("\n", F.lit("\nNOTE: This page requires JavaScript execution to access its content."), F.lit("Static metadata only:"), meta)
    body = F.concat_ws("\n", F.lit("\n--- EVIDENCE ---"), F.array_join(F.transform("evidence", item), "\n"), F.lit("\n--- DIAGNOSTICS ---"), F.concat(F.lit("Pages fetched: "), F.col("diagnostics.pages_fetched").cast("string")))
    rest = F.when(F.col("status") == "js_required", shell).when(F.size(F.coalesce("evidence", F.array())) == 0, none).otherwise(body)
    return results.select("query_id", F.concat_ws("\n", head, moved, rest).alias("text"))


def message_text(results: DataFrame) -> DataFrame:
    """query_id, text: a result as a short message: status, counts, a repaired URL, then each piece of evidence under its source."""
    n = lambda c: F.size(F.coalesce(c, F.array())).cast("string")
    nav = F.col("navigation")
    found = F.coalesce(nav["resolved"], F.lit(False))
    head = [F.concat(F.lit("Status: "), F.col("status")), F.concat(F.lit("Sources fetched: "), n("sources")), F.concat(F.lit("Evidence passages: "), n("evidence"))]
    repaired = F.when(found & (nav["resolved_url"] != F.col("url")), F.concat(F.lit("URL repaired: "), F.col("url"), F.lit(" → "), nav["resolved_url"]))
    lost = F.when(~found, F.concat(F.lit("URL could not be resolved: "), F.coalesce(nav["reason"], F.lit("unknown"))))
    section = lambda e: F.when(F.length(e["section"]) > 0, F.concat(F.lit("Section: "), e["section"]))
    items = F.array_join(F.transform("evidence", lambda e: F.concat_ws("\n", F.lit(""), F.concat(F.lit("Source: "), e["source_url"]), section(e), e["text"])), "\n")
    none = F.size(F.coalesce("evidence", F.array())) == 0
    rest = F.when(none, F.concat_ws("\n", F.lit("No relevant evidence found."), lost)).otherwise(F.concat(items, F.lit("\n")))
    return results.select("query_id", F.concat_ws("\n", *head, repaired, rest).alias("text"))


def function_answer(results: DataFrame, keep: int = 5) -> DataFrame:
    """query_id, json: a result as the object of a function's response, with its first `keep` pieces of evidence. Null fields are left out."""
    nav = F.col("navigation")
    evidence = F.transform(F.slice(F.col("evidence"), 1, keep), lambda e: F.struct(e["source_url"].alias("sourceUrl"), e["text"].alias("text"), e["section"].alias("section"), e["relevance"].alias("relevance")))
    nav = F.struct(nav["resolved"].alias("resolved"), nav["method"].alias("method"), nav["resolved_url"].alias("resolvedUrl"), nav["reason"].alias("reason"))
    count = F.size(F.coalesce("evidence", F.array())).alias("evidenceCount")
    return results.select("query_id", F.to_json(F.struct("status", "query", count, nav.alias("navigation"), F.coalesce(evidence, F.array()).alias("evidence"))).alias("json"))


def rpc_reply(results: DataFrame, call_id: str = "query_id") -> DataFrame:
    """query_id, json: a result as the JSON-RPC reply to a tool call, its JSON as the one text of the content."""
    made = json_result(results).withColumnRenamed("json", "__json")
    rows = made if call_id == "query_id" else made.join(results.select("query_id", call_id), "query_id")
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("__json").alias("text")))
    return rows.select("query_id", F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col(call_id).alias("id"), F.struct(content.alias("content")).alias("result"))).alias("json"))


def json_result(results: DataFrame, keep: int | None = None) -> DataFrame:
    """query_id, json: a result as JSON, with its first `keep` pieces of evidence."""
    rows = results if keep is None else results.withColumn("evidence", F.slice("evidence", 1, keep))
    return rows.select("query_id", F.to_json(F.struct(*[c for c in rows.columns if c != "query_id"])).alias("json"))


__all__ = ["Engine", "best_result", "function_answer", "json_result", "message_text", "repair_urls", "rpc_reply", "text_block", "url_arguments"]
