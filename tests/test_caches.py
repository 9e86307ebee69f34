"""Caches over logs and streams of fetches, and the shapes that results are answered in."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleanery.plans.retrieve import function_answer, message_text, rpc_reply
from gleanery.streaming.pages import cacheable, cached_fetch_stream, cached_fetches, live_answers

START = datetime(2024, 1, 1)
LOG = "request_id long, key string, ts timestamp, cacheable boolean"


def at(seconds):
    return START + timedelta(seconds=seconds)


ROWS = [
    (1, "a", at(0), True), (2, "a", at(300), True), (3, "a", at(301), False), (4, "a", at(302), True), (5, "a", at(302), True), (6, "a", at(700), None),
    (7, "b", at(5), False), (8, "b", at(6), True), (9, "b", at(7), True), (10, None, at(1), True), (11, None, at(2), True),
]
HITS = {1: False, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False, 8: False, 9: True, 10: False, 11: False}


def test_a_hit_does_not_renew_its_answer(spark):
    log = spark.createDataFrame(ROWS, LOG)
    assert {r.request_id: r.hit for r in cached_fetches(log).collect()} == HITS
    assert cached_fetches(log.limit(0)).count() == 0


def test_the_stream_gives_the_same_hits(spark, tmp_path):
    parts = [[r for r in ROWS if r[2] < at(301)], [r for r in ROWS if at(301) <= r[2] < at(600)], [r for r in ROWS if r[2] >= at(600)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log/part={i}")
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(*[f"{tmp_path}/log/part=*"])
    query = cached_fetch_stream(stream).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.request_id: r.hit for r in spark.table("hits").collect()}
    assert got == {i: hit for i, hit in HITS.items() if i < 10}


def test_live_answers(spark):
    rows = [
        ("https://a.com/x", 200, "old", at(0)), ("https://a.com/x/#f", 200, "new", at(100)), ("https://a.com/x", 500, "bad", at(200)),
        ("https://a.com/late", 200, "gone", at(-400)), ("not a url", 200, "kept", at(50)),
    ]
    fetched = spark.createDataFrame(rows, "url string, status int, body string, fetched_at timestamp")
    found = live_answers(fetched, F.lit(at(250)))
    assert found.columns == fetched.columns
    assert sorted(r.body for r in found.collect()) == ["kept", "new"]


@pytest.mark.parametrize(("status", "mime", "size", "stored"), [(200, "text/html", 10, True), (200, "text/html", 11, False), (200, "application/pdf", 11, True), (404, "text/html", 1, False), (None, None, None, False)])
def test_cacheable(spark, status, mime, size, stored):
    row = spark.createDataFrame([(status, mime, size)], "status int, mime string, size long")
    assert row.select(cacheable(F.col("status"), F.col("mime"), F.col("size"), 10).alias("c")).first().c is stored


RESULT = """query_id long, url string, query string, status string, navigation struct<resolved:boolean,method:string,resolved_url:string,reason:string>,
  sources array<string>, evidence array<struct<rank:int,source_url:string,text:string,section:string,relevance:double>>"""


def test_answers(spark):
    items = [(i, f"u{i}", f'say "{i}"', None if i % 2 else "S", 0.5) for i in range(1, 8)]
    rows = [(1, "u", "q", "success", (True, "redirect", "v", None), ["u1"], items), (2, "u", None, "failed", None, None, None), (3, "u", "q", "not_found", (False, "none", None, None), [], [])]
    results = spark.createDataFrame(rows, RESULT)
    text = {r.query_id: r.text for r in message_text(results).collect()}
    assert text[1].startswith('Status: success\nSources fetched: 1\nEvidence passages: 7\nURL repaired: u → v\n\nSource: u1\nsay "1"\n\nSource: u2\nSection: S\nsay "2"\n')
    assert text[2] == text[3].replace("not_found", "failed") == "Status: failed\nSources fetched: 0\nEvidence passages: 0\nNo relevant evidence found.\nURL could not be resolved: unknown"
    made = {r.query_id: json.loads(r.json) for r in function_answer(results).collect()}
    assert [e["sourceUrl"] for e in made[1]["evidence"]] == ["u1", "u2", "u3", "u4", "u5"]
    assert made[1]["evidence"][0] == {"sourceUrl": "u1", "text": 'say "1"', "relevance": 0.5}
    assert made[1]["evidenceCount"] == 7
    assert made[2]["evidence"] == []
    reply = {r.query_id: json.loads(r.json) for r in rpc_reply(results.withColumn("call", F.concat(F.lit("c"), "query_id")), "call").collect()}
    assert (reply[1]["jsonrpc"], reply[1]["id"]) == ("2.0", "c1")
    assert json.loads(reply[1]["result"]["content"][0]["text"])["evidence"][6]["source_url"] == "u7"
