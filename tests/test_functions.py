"""Text, URL, MIME and planning functions, table-driven."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.functions import mime as M
from gleanery.functions import planning as P
from gleanery.functions import text as T
from gleanery.functions import url as U


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_tokens(spark):
    texts = ["The Settings of OAuth-login!", "running tests quickly", "nation tion ment", "", None, "Éa x yy", "ings sings classes ladies pass"]
    assert column(spark, texts, T.tokens) == [
        ["sett", "oauth", "login"], ["runn", "test", "quickly"], ["na", "", ""], [], None, ["yy"], ["ing", "sing", "class", "lady", "pass"],
    ]


def test_term_rows_equal_tokens(spark):
    docs = spark.createDataFrame([(1, "installing the deployments and errors"), (2, None), (3, "")], "doc_id long, text string")
    rows = T.term_rows(docs).collect()
    assert sorted(r.term for r in rows) == sorted(docs.where("doc_id = 1").select(T.tokens(F.col("text"))).first()[0])
    assert {r.doc_id for r in rows} == {1}


def test_fingerprint_and_strip(spark):
    assert column(spark, ["  A \n b\t", "x" * 300], T.fingerprint) == ["a b", "x" * 200]
    assert column(spark, ["<p>One<br>two</p>  three"], T.strip_tags) == ["One two three"]
    assert column(spark, ["see http://a.b/c) and http://a.b/c <https://d.e>"], T.bare_links) == [["http://a.b/c", "https://d.e"]]


def test_windows(spark):
    long = "w" * 1700
    got = column(spark, [long, "short", "", None], lambda x: F.transform(T.windows(x), lambda w: F.struct(w["char_offset"], F.length(w["text"]))))
    assert [tuple(w) for w in got[0]] == [(0, 800), (650, 800), (1300, 400)]
    assert [tuple(w) for w in got[1]] == [(0, 5)]
    assert got[2] == []
    assert not got[3]


def test_window_headings(spark):
    text = "intro\n\n# Setup\nfirst step\n\nsecond\n\n[Page 2] more"
    line = column(spark, [text], lambda x: F.transform(T.windows(x), lambda w: F.struct(w["section"], w["text"])))[0]
    assert [tuple(w) for w in line][:2] == [(None, "intro"), ("Setup", "first step\n\nsecond")]
    whole = column(spark, [text], lambda x: F.transform(T.windows(x, "paragraph"), lambda w: F.struct(w["section"], w["text"])))[0]
    assert [tuple(w) for w in whole] == [(None, "intro"), ("Setup\nfirst step", "second")]


NORMALISED = [
    ("https://example.com/page#section", "https://example.com/page"),
    ("https://example.com:443/page", "https://example.com/page"),
    ("http://example.com:80/page", "http://example.com/page"),
    ("http://example.com:8080/page", "http://example.com:8080/page"),
    ("https://example.com/page?utm_source=x&id=1", "https://example.com/page?id=1"),
    ("https://example.com/page?fbclid=abc", "https://example.com/page"),
    ("https://example.com/page?b=2&a=1", "https://example.com/page?a=1&b=2"),
    ("https://EXAMPLE.com/Page/", "https://example.com/Page"),
    ("https://example.com", "https://example.com/"),
    ("https://example.com/a/../b/./c", "https://example.com/b/c"),
    ("ftp://example.com/x", None),
    ("not a url", None),
    ("", None),
    (None, None),
]


def test_normalise(spark):
    assert column(spark, [a for a, _ in NORMALISED], U.normalise) == [b for _, b in NORMALISED]


@pytest.mark.parametrize(
    ("href", "resolved"),
    [("/x", "https://a.com/x"), ("y", "https://a.com/d/y"), ("../z", "https://a.com/z"), ("//b.com/q", "https://b.com/q"), ("?p=1", "https://a.com/d/e?p=1"), ("http://c.com", "http://c.com/"), ("mailto:x@y.z", None), ("#f", "https://a.com/d/e#f")],
)
def test_resolve(spark, href, resolved):
    assert spark.range(1).select(U.resolve(F.lit(href), F.lit("https://a.com/d/e"))).first()[0] == resolved


def test_origin_and_errors(spark):
    urls = ["https://a.com:443/x", "https://a.com/y", "http://a.com/", "https://a.com:8443/", None, "nope", "ftp://a.com/", "http://a.com:22/"]
    assert column(spark, urls, U.origin)[:4] == ["https://a.com", "https://a.com", "http://a.com", "https://a.com:8443"]
    assert column(spark, urls, U.url_error) == [None, None, None, None, "INVALID_URL", "INVALID_URL", "UNSAFE_SCHEME", "UNSAFE_PORT"]


def test_body_limits(spark):
    rows = spark.createDataFrame([(bytearray(b"x" * 10), 10), (bytearray(b"x" * 2000), 10), (bytearray(b"x"), 99), (bytearray(b"x" * 60), None)], "b binary, n long")
    assert [r[0] for r in rows.select(M.body_error(F.col("b"), F.col("n"), 50)).collect()] == [None, "RESPONSE_TOO_LARGE", "RESPONSE_TOO_LARGE", "RESPONSE_TOO_LARGE"]
    assert rows.select(M.body_error(F.col("b"), F.col("n"), 5000)).collect()[1][0] == "COMPRESSION_BOMB"


def test_planning(spark):
    assert column(spark, ["login", "install guide", "how do I set the cache time here", "list every plan", "latest"], P.infer_mode) == ["fast", "deep", "balanced", "deep", "deep"]
    assert column(spark, ["fast", "balanced", "deep"], P.max_pages) == [2, 6, 12]
    assert set(column(spark, ["auth"], P.expand_tokens)[0]) >= {"auth", "login", "oauth"}
    as_of = F.lit(datetime(2026, 1, 1))
    assert column(spark, ["7", None, "x"], lambda x: P.retry_delay_ms(x, F.lit(1), as_of)) == [7000, 2000, 2000]
