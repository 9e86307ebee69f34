"""Every operator and pipeline stage on empty tables, nulls in every column, very long texts, ties, repeated rows and clashing columns."""

import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as pipeline
from gleanery.llm import chat, exact_dedup, minhash, mixing, sentencepiece, substring_dedup, topk_search, url_filter, warc

SF = "/root/testdata/sf0.001"
CLASH = "size long, target double, score double, digest string, __row string, word string, keep_id long, text_key long, component_id long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (1, 2.0, 0.5, "d", "r", "w", 3, 4, 5)
LONG = " ".join(f"{i % 977}w{i % 89}" for i in range(120_000))
TEXTS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (1, "alpha beta gamma delta epsilon zeta", "en", "s"), (1, "another text under the same id here", "en", "s"), (None, "no id but a text of its own words", None, None),
    (None, "no id but a second text of other words", None, None), (None, None, None, None), (2, None, "de", "s"), (3, "", "de", "t"), (4, " \t\n\u000b", None, "t"), (5, LONG, "en", "t"), (6, "x" * 300_000, "en", "t"), (7, "▁ é 漢字 \U0001f600", "en", "t"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, *EXTRA) for r in TEXTS], DOCS).repartition(3)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stage_on_an_empty_table(spark, docs, name, stage):
    found = stage(spark, docs.limit(0), SF)
    assert found.count() == 0
    if name != pipeline.STAGES[-1][0]:
        assert found.schema == docs.schema


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stage_on_awkward_rows(spark, docs, name, stage):
    found = stage(spark, docs, SF)
    rows = found.collect()
    if name == "sentencepiece":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in TEXTS)
        assert all(r.round_trip for r in rows)
        return
    assert found.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in rows)
    every = Counter(r[:2] for r in TEXTS)
    assert all(tuple(r)[5:] == EXTRA for r in rows)
    if name == "toxicity":
        assert got == every
    elif name == "mixing":
        assert set(got) <= set(every)
    else:
        assert set(t for _, t in got if t and t.strip()) == set(t for _, t in every if t and t.strip())
        assert max(n for (_, t), n in got.items() if t and t.strip()) == 1


def test_mixing_counts_repeated_rows_and_ignores_clashing_columns(docs):
    rows = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in TEXTS)
    sizes = Counter()
    for r in TEXTS:
        sizes[r[3]] += len((r[1] or "").split())
    assert {r.source: r.source_size for r in rows} == dict(sizes)
    taken = Counter()
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[r.source] - r.target) < 1 for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_exact_and_near_groups_of_rows_that_share_an_id(docs):
    for found in (exact_dedup.exact_groups(docs), minhash.near_duplicates(docs, width=3, percent=85)):
        assert Counter(r.doc_id for r in found.collect()) == Counter(r[0] for r in TEXTS)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == minhash.near_duplicates(docs.limit(0)).count() == 0


def test_substrings_of_awkward_rows(docs):
    rows = substring_dedup.remove_repeats(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in TEXTS)
    assert {r.kept_sha256 for r in rows if r.doc_id == 3} == {hashlib.sha256(b"").hexdigest()}


PAGES = [(i % 4, f"http://h{i % 3}.co.uk/{i}") for i in range(12)] + [(5, "http://www.h1.co.uk/x"), (6, "http://one.org/" + "y" * 100_000), (7, "http://tie.org/a"), (8, "http://tie.org/b"), (None, "http://h0.co.uk/"), (9, None)]
OUTCOMES = [(0, 0), (1, 1), (2, 1), (7, 1), (8, 0), (3, None), (None, 1)]


def test_url_filter_agrees_with_its_sql_on_ties_repeats_and_long_urls(spark):
    pages = spark.createDataFrame([(*r, "x", 0.5) for r in PAGES], "page_id long, url string, host string, lower double")
    labels = spark.createDataFrame(OUTCOMES, "id long, bad int")
    got = [tuple(r) for r in url_filter.filter_urls(pages, labels).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", PAGES)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INTEGER)")
    con.executemany("INSERT INTO labels VALUES (?, ?)", [(i, None if bad is None else 1 - bad) for i, bad in OUTCOMES])
    assert sorted(got, key=str) == sorted(con.execute(url_filter.OP7_SQL).fetchall(), key=str)
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0
    assert all(v == "allow" for *_, v in url_filter.filter_urls(pages, labels.limit(0)).collect())


def test_second_level_suffixes_share_no_reputation(spark):
    pages = [(i, f"http://bad{i % 5}.co.uk/{i}") for i in range(40)] + [(100 + i, f"http://good{i % 5}.com.au/{i}") for i in range(40)] + [(200, "http://new.co.uk/"), (201, "http://new.com.au/"), (202, "http://new.uk/"), (203, "http://co.uk/")]
    outcomes = [(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)]
    got = [tuple(r) for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "id long, bad int")).collect()]
    assert {r[0]: r[4] for r in got if r[0] >= 200} == {200: "block", 201: "allow", 202: "allow", 203: "allow"}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT unnest($1) AS page_id, unnest($2) AS url", [[i for i, _ in pages], [u for _, u in pages]])
    con.execute("CREATE TABLE labels AS SELECT unnest($1) AS doc_id, unnest($2) AS quality", [[i for i, _ in outcomes], [1 - bad for _, bad in outcomes]])
    assert sorted(got, key=str) == sorted(con.execute(url_filter.OP7_SQL).fetchall(), key=str)


def test_one_very_long_turn_and_nulls(spark):
    rows = [(1, 0, "user", LONG), (1, 1, "assistant", LONG + " </s>"), (1, 2, None, None), (2, None, "assistant", "a"), (2, None, "assistant", "a")]
    formatted = chat.format_conversations(spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn int, role string, text string, ids string, n_turns int"))
    read = {r.conv_id: r for r in chat.read_conversations(formatted).collect()}
    assert read[1].n_turns == 3
    assert read[1].loss_chars == len(LONG) + 5
    assert read[2].loss_chars == 2


def test_archives_and_search_of_nothing(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    vectors = spark.createDataFrame([(None, None, 1), (0, None, 1), (50, [], 1)], "vec_id long, embedding array<float>, rank int")
    assert topk_search.top_k(vectors).count() == 0
    lone = spark.createDataFrame([(50, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk_search.top_k(lone).count() == 0


def test_pieces_of_a_table_of_one_word(spark):
    docs = spark.createDataFrame([(1, "word", "p"), (1, "word", "p"), (2, "word " * 50_000, "p")], "doc_id long, text string, word string")
    rows = sentencepiece.encode_documents(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, 2: 1}
    assert all(r.round_trip for r in rows)
