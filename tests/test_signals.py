"""Signals: nulls, empty inputs and the rules' edges."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import intent as I
from gleanery.operators import signals as N


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("query", "variants"), [(None, []), ("  ", []), ("How does caching work?", ["How does caching work", "caching"]), ("how", ["how"]), ("latest api", ["latest api", "latest api documentation"])])
def test_variants(spark, query, variants):
    assert one(spark, I.query_variants(F.col("q")), q=query) == variants


def test_intent_of_nothing(spark):
    found = one(spark, I.query_intent(F.col("q")), q=None)
    assert found.freshness == "low"
    assert not found.technical


@pytest.mark.parametrize(("url", "site"), [("https://a.b.example.co.uk/x", "example.co.uk"), ("http://www.example.com:8080", "example.com"), ("http://10.0.0.1/", "10.0.0.1"), ("http://localhost/", "localhost")])
def test_site(spark, url, site):
    assert one(spark, N.site(F.col("u")), u=url) == site


@pytest.mark.parametrize(("url", "relation"), [("https://cdn.example.com/r.pdf", "same_site"), ("https://www.example.com/r", "same_origin"), ("https://notexample.com/", "external"), ("https://x.docs.org/", "allowed"), (None, None), ("mailto:a@b.c", None)])
def test_relation(spark, url, relation):
    assert one(spark, N.site_relation(F.col("u"), F.lit("https://www.example.com/"), ["docs.org"]), u=url) == relation


@pytest.mark.parametrize(("url", "reason"), [("https://a.com/cart/add", "action"), ("https://a.com/x?do=delete", "action"), ("https://a.com/undeleted", None), ("https://a.com/f.woff2", "asset"), ("https://x.doubleclick.net/", "tracker")])
def test_skip(spark, url, reason):
    assert one(spark, N.skip_reason(F.col("u")), u=url) == reason


def test_directives_without_any(spark):
    assert list(one(spark, N.directives(F.col("h"), F.col("r")), h=None, r=None)) == [False] * 4


def test_freshness_prefers_the_article(spark):
    columns = [F.col(c) for c in "abcde"]
    found = one(spark, N.freshness(*columns), a="never", b=None, c="Tue, 02 Jan 2024 03:04:05 GMT", d="2025-01-01", e="Wed, 03 Jan 2024 00:00:00 GMT")
    assert (found.signal, str(found.at)) == ("feed", "2024-01-02 03:04:05")
    assert tuple(one(spark, N.freshness(*columns), a=None, b=None, c=None, d=None, e=None)) == (None, None)


def test_agreement(spark):
    claims = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (2, "a", "x"), (2, "b", "y"), (3, "a", "x"), (3, "a", "x"), (4, "a", None), (5, None, "x")], "k int, source string, value string")
    assert {r.k: r.agreement for r in N.agreement(claims, ["k"]).collect()} == {1: "agreed", 2: "mixed", 3: "single", 4: "none", 5: "single"}


def test_diverse_sites(spark):
    rows = spark.createDataFrame([(1, i, "https://a.com/" + str(i), 1.0 - i / 100) for i in range(5)] + [(1, 9, "https://b.com/", 0.1), (1, 10, None, 0.05)], "query_id int, pos int, url string, score double")
    assert [r.pos for r in N.diverse_sites(rows, per_site=2).orderBy("rank").collect()] == [0, 1, 9, 10]


def test_field_bm25(spark):
    docs = spark.createDataFrame([(1, "caching guide", "words"), (2, "other", "caching guide"), (3, None, None), (4, "guide", "to caching")], "doc_id int, title string, body string")
    asked = spark.createDataFrame([(1, "caching guide"), (2, "")], "query_id int, query string")
    rows = {r.doc_id: r for r in N.field_bm25(docs, asked, {"title": "title", "body": "body"}).collect()}
    assert set(rows) == {1, 2, 4}
    assert rows[1].score == 1.0 > rows[2].score
    assert [rows[i].phrase for i in (1, 2, 4)] == [True, True, False]
    assert N.field_bm25(docs.limit(0), asked, {"title": "title"}).count() == 0


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, "https://a.com/x", "https://a.com/x/", "https://a.com/x"), (1, "https://a.com/y", None, "https://a.com/z"), (2, "https://a.com/y", "https://a.com/z", None)], "k int, asked string, expected string, returned string")
    rows = {r.k: r for r in N.evaluation(cases, ["k"]).collect()}
    assert (rows[1].url_recall, rows[1].source_precision, rows[1].false_correction_rate) == (1.0, 0.5, 1.0)
    assert (rows[2].url_recall, rows[2].source_precision, rows[2].correction_accuracy) == (0.0, None, None)


def test_site_index_without_html(spark):
    row = N.site_index(spark.createDataFrame([("https://a.com/", None), ("https://a.com/b", "")], "url string, html string")).orderBy("url").collect()
    assert (row[0].canonical, row[0].title, row[0].content_hash) == ("https://a.com/", None, None)
    assert (row[1].title, row[1].headings) == (None, [])
