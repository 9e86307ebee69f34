"""The pipeline's stages decide row by row, also where ids are null or repeat."""

import random

import pytest

import corpus_pipeline as pipeline
from gleanery.llm.exact_dedup import drop_exact_duplicates
from gleanery.llm.minhash import drop_near_duplicates
from gleanery.llm.mixing import mix, mixed_documents

DOCS = "doc_id long, text string, source string"
LAST = (1 << 63) - 1


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def lone():
    return [prose(60, i) for i in range(6)]


def test_toxic_rows_go_alone(spark, lone, tmp_path):
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        rows.append((i, prose(30, 1000 + i) + (" wretch" if toxic else ""), "a"))
        labels.append((i, int(toxic)))
    clean = [(None, lone[0], "a"), (None, lone[1], "b"), (None, None, "b"), (7000, lone[2], "a")]
    toxic = [(None, lone[3] + " wretch", "a"), (7000, lone[4] + " wr3tch", "a")]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows + clean + toxic, DOCS)
    kept = pipeline.reject_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert texts(kept) == sorted([(i, t) for i, t, _ in rows if "wretch" not in t] + [r[:2] for r in clean], key=str)


def test_exact_copies_go_alone(spark, lone):
    rows = [(1, lone[0]), (None, lone[0]), (None, lone[1]), (None, lone[2]), (5, lone[3]), (5, lone[0] + "\n"), (5, lone[4]), (6, lone[4]), (LAST, lone[5]), (4, lone[3])]
    stay = [(None, lone[1]), (None, lone[2]), (5, lone[0] + "\n"), (5, lone[4]), (LAST, lone[5]), (4, lone[3])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    assert texts(drop_exact_duplicates(docs)) == sorted(stay, key=str)


def test_near_copies_go_alone(spark, lone):
    near = [t + " tail" for t in lone]
    rows = [(1, lone[0]), (None, near[0]), (None, lone[1]), (None, lone[2]), (None, near[2]), (5, lone[3]), (2, near[3]), (5, lone[4]), (7, near[4]), (None, None), (5, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS)
    got = texts(drop_near_duplicates(docs, width=5, percent=80))
    either = {(None, lone[2]), (None, near[2])}  # of null ids alone, one stays
    assert len(either & set(got)) == 1
    assert [r for r in got if r not in either] == sorted([(1, lone[0]), (None, lone[1]), (2, near[3]), (5, lone[4]), (None, None), (5, "")], key=str)


def test_each_row_is_mixed_by_itself(spark):
    rows = [(None, prose(10, i), "a") for i in range(40)] + [(7, prose(10, 100 + i), "b") for i in range(40)] + [(7, prose(10, 999), "b")] * 3 + [(200 + i, prose(3 + i % 5, 300 + i), None) for i in range(40)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", size int")
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = texts(mixed)
    for source in ("a", "b", None):
        plan = [r for r in mix(docs).collect() if r.source == source]
        whole = sum(r.repetitions + (2 * r.partial >= max(r.size, 1)) for r in plan)
        assert sum(1 for r in mixed.collect() if r.source == source) == whole
    assert got == texts(mixed_documents(docs.repartition(3)))


def test_a_table_read_twice_is_reduced_to_one(spark, lone):
    rows = [(1, lone[0], "x"), (None, lone[1], "x"), (3, lone[2], None), (4, None, "x"), (LAST, lone[1], "x")]
    docs = spark.createDataFrame([r for r in rows for _ in range(3)] + [(3, lone[2], "y")], DOCS).repartition(4)
    for drop in (drop_exact_duplicates, drop_near_duplicates):
        kept = drop(docs)
        assert kept.columns == docs.columns
        got = texts(kept)
        assert [t for _, t in got if t != lone[1]] == [t for i, t in sorted((r[:2] for r in rows), key=str) if t != lone[1]]
        assert sum(t == lone[1] for _, t in got) == 1
        assert [r.source for r in kept.where("doc_id = 3").collect()] == [r.source for r in drop(docs.repartition(2)).where("doc_id = 3").collect()]
