"""The deobfuscator's Viterbi path against all paths of its lattice, and WARC records of repeated rows."""

import itertools
import re

import numpy as np
import pytest

from gleanery.llm import toxicity, warc


def cost_of(path, model):
    a = b = 0
    total = 0.0
    for out, price in path:
        total += price
        for c in out:
            z = toxicity._class(c)
            total -= model[a, b, z]
            a, b = b, z
    return total - model[a, b, 0]


@pytest.mark.parametrize("token", ["", "a", "id1ot", "w r e t c h", "b4d-w0rd", "llooss3r", "h.e.l.l.o", "!!", "4$$", "é1", "a  b", "mmm", "*" * 3])
def test_decode_finds_the_cheapest_path(token):
    data = "the idiot was a bad wretch and a loser who said hello to the hell hole of losers"
    model = toxicity.log_model(toxicity.trigram_counts(data.encode()).astype(float))
    runs = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.S)]
    paths = list(itertools.product(*[toxicity.arcs_of(ch, n) for ch, n in runs]))
    best = min(cost_of(p, model) for p in paths)
    got = toxicity.decode(token, model)
    assert min(cost_of(p, model) for p in paths if "".join(out for out, _ in p) == got) == pytest.approx(best)


def test_very_long_and_repeated_texts(spark):
    rows = [(1, "plain words " * 60_000), (1, "plain words " * 60_000), (2, "w" * 200_000), (3, "1" * 100_000), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.score) for r in toxicity.toxicity(docs, spark.createDataFrame([(1, 0), (2, 1)], "id long, toxic int")).collect()]
    assert sorted([i for i, _ in got], key=str) == sorted([i for i, _ in rows], key=str)
    assert len({s for i, s in got if i == 1}) == 1
    assert all(0 <= s <= 1 for _, s in got)


def test_repeated_rows_have_records_of_their_own(spark):
    body = "<p>" + "y" * 300
    rows = [(1, "http://a/", body), (1, "http://a/", body), (2, "http://b/", body), (2, "http://b/", body), (3, "http://c/", "z" * 700_000), (None, None, None)]
    bundles = warc.write_archives(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_id string").repartition(3))
    index = [r.record_id for r in warc.record_index(bundles).collect()]
    assert len(index) == len(set(index)) == len(rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(bundles).collect()), key=str)
    assert got == sorted([(1, "response", None, 303)] * 2 + [(2, "revisit", 1, 303)] * 2 + [(3, "response", None, 700_000), (None, "response", None, 0)], key=str)
    stored = {r.bundle: bytes(r.content) for r in bundles.collect()}
    heads = [warc.decode_record(warc.read_frame(stored[e.bundle], e.frame), e.offset)[0] for e in warc.record_index(bundles).collect()]
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in heads)
    assert {h["WARC-Refers-To-Target-URI"] for h in heads if h["WARC-Type"] == "revisit"} == {"http://a/"}
    assert (np.array([np.int64(h["Content-Length"]) for h in heads]) >= 0).all()
