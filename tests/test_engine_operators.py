"""BM25, evidence, candidates and policies."""

import math

import pytest
from pyspark.sql import functions as F

from gleanery.operators import bm25 as B
from gleanery.operators import candidates as C
from gleanery.operators import evidence as E
from gleanery.operators import policy as R

CORPUS = [(1, "authentication middleware for the api"), (2, "database connection pooling"), (3, "authentication tokens in an api gateway"), (4, "cooking pasta at home"), (5, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


def asked(spark, query):
    return spark.createDataFrame([(1, query)], "query_id long, query string")


def test_bm25(spark, docs):
    rows = B.top_documents(docs, asked(spark, "authentication middleware")).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [1, 3]
    assert rows[0].score == 1.0
    assert 0 < rows[1].score < 1
    n, mean = 5, (3 + 3 + 4 + 3) / 5
    one = lambda df, length: math.log((n - df + 0.5) / (df + 0.5) + 1) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / mean))
    assert rows[1].score == pytest.approx(one(2, 4) / (one(2, 3) + one(1, 3)))


@pytest.mark.parametrize("query", ["", "the of", "zebra"])
def test_bm25_without_hits(spark, docs, query):
    assert B.bm25(docs, asked(spark, query)).count() == 0


def test_bm25_repeated_query_terms_count_twice(spark, docs):
    once = {r.doc_id: r.score for r in B.bm25(docs, asked(spark, "api middleware")).collect()}
    twice = {r.doc_id: r.score for r in B.bm25(docs, asked(spark, "api api middleware")).collect()}
    assert twice[3] > once[3]


def test_passages(spark):
    text = "alpha beta " * 100 + "gamma delta " * 100
    rows = B.passages(spark.createDataFrame([(1, text, "gamma"), (2, "nothing here", "gamma"), (3, None, "gamma"), (4, "gamma", None)], "doc_id long, text string, query string")).collect()
    assert {r.doc_id for r in rows} == {1}
    assert max(r.relevance for r in rows) == 1.0
    assert len(rows) <= B.PER_DOCUMENT
    assert all(r.relevance >= B.MIN_RELEVANCE and "gamma" in r.text for r in rows)


def test_evidence(spark):
    rows = spark.createDataFrame([(1, f"s{i // 6}", f"text {i}", 1.0 - i / 100, i) for i in range(12)] + [(1, "s9", "TEXT  0", 0.99, 99)], "query_id long, source_url string, text string, relevance double, encounter int")
    kept = E.dedupe_passages(rows, ["encounter"])
    assert kept.count() == 12
    top = E.top_evidence(kept).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3, 4, 7, 8, 9, 10]
    best = E.source_relevance(spark.createDataFrame([(1, "s0"), (1, "none")], "query_id long, url string"), kept).collect()
    assert {r.url: r.relevance for r in best} == {"s0": 1.0, "none": 0.0}


def test_stop_and_budget(spark):
    rows = spark.createDataFrame([(1, i, "balanced", 2, 3) for i in range(5)], "query_id long, rank int, mode string, n_good long, cost int")
    assert [r["rank"] for r in E.stop_prefix(rows).orderBy("rank").collect()] == [0, 1]
    assert [r["rank"] for r in E.budget_cut(rows, F.lit(8)).orderBy("rank").collect()] == [0, 1]


def test_source_score(spark):
    rows = spark.createDataFrame([(200, "Title"), (404, None), (301, "ab")], "status int, title string")
    assert [r[0] for r in rows.select(F.round(E.source_score(F.col("status"), F.col("title")), 6)).collect()] == [0.8, 0.2, 0.5]


def test_repair_never_leaves_the_origin_or_the_observed(spark):
    observed = spark.createDataFrame([("https://a.com/docs/setup", 1, None, None), ("https://b.com/docs/install", 2, None, None)], "url string, pos long, anchor_text string, priority double")
    rows = C.repair_urls(spark.createDataFrame([(1, "https://a.com/docs/install", None), (2, "https://a.com/docs/setups", None)], "query_id long, url string, canonical string"), observed).orderBy("query_id").collect()
    assert not rows[0].resolved
    assert rows[0].reason == "no_safe_url_match"
    assert rows[1].resolved_url == "https://a.com/docs/setup"


def test_find_in_sitemap(spark):
    entries = spark.createDataFrame([("https://a.com/x/", 1, "2024-01-01", 0.5), ("https://a.com/x", 2, None, None)], "url string, pos int, lastmod string, priority double")
    rows = C.find_in_sitemap(spark.createDataFrame([("https://a.com/x",), ("https://a.com/x#f",), ("https://a.com/y",)], "url string"), entries)
    assert {r.url: r.entry_url for r in rows.collect()} == {"https://a.com/x": "https://a.com/x", "https://a.com/x#f": "https://a.com/x/", "https://a.com/y": None}


@pytest.mark.parametrize(
    ("ip", "blocked"),
    [("127.0.0.1", True), ("172.31.255.255", True), ("172.32.0.0", False), ("8.8.8.8", False), ("256.1.1.1", False), ("::1", True), ("fe80::1", True), ("2606:4700::1111", False), ("::ffff:192.168.0.1", True), ("::ffff:c0a8:1", True), ("fd00:ec2::254", True), ("example", False)],
)
def test_blocked_ip(spark, ip, blocked):
    assert spark.range(1).select(R.blocked_ip(F.lit(ip))).first()[0] is blocked


def test_robots_grammar(spark):
    # a line that is only a comment counts as blank and ends its group; rules without an agent behind them are lost
    text = "User-agent: A\nUser-agent: B\nDisallow: /x\nUser-agent: C\nAllow: /\n\nCrawl-delay: 9\nUser-agent: *\nCrawl-delay: abc\n# note\nDisallow: /y # tail"
    rows = R.robots_groups(spark.createDataFrame([("o", text), ("p", None)], "origin string, text string")).orderBy("group_no").collect()
    assert [(r.agents, [tuple(x) for x in r.rules]) for r in rows] == [(["a", "b"], [("/x", False)]), (["c"], [("/", True)]), (["*"], [])]


def test_domain_policy(spark):
    urls = spark.createDataFrame([("https://a.com/",), ("https://x.a.com/",), ("https://b.com/",)], "url string")
    one = lambda d: spark.createDataFrame([(d,)], "domain string")
    assert [r.url for r in R.domain_policy(urls, one("a.com"), one("x.a.com")).collect()] == ["https://a.com/"]
    assert R.domain_policy(urls).count() == 3
