"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import chat, exact_dedup, minhash, mixing, sentencepiece, substring_dedup, topk_search, toxicity, url_filter, warc
from gleanery.llm.common import gram_hashes, word_hashes, word_spans
from gleanery.llm.graph import components

DOCS = "doc_id long, text string, source string, digest string, node string, __id string, shard int"
random.seed(7)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(5)) for _ in range(300)]


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 1)
BASE = prose(200, 2)
TEXTS = [
    (1, BASE), (2, BASE.replace(" ", "\n")), (3, BASE + " tail"), (4, prose(30, 3) + " " + PASSAGE + " " + prose(10, 4)), (5, prose(5, 5) + " " + PASSAGE), (6, None), (7, ""), (8, " \t\n"), (9, "one two"), (10, "One  two"),
    (11, "word " * 100), (12, prose(40, 6) + " " + "w" * 30_000), (13, BASE.upper()), (14, "a b c"), (15, " ".join(BASE.split()[:150])),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, f"s{i % 3}" if i % 4 else None, "x", "y", "z", 1) for i, t in TEXTS], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return (text or "").encode().split()


def test_word_hashes_depend_on_the_word_alone():
    raw = np.frombuffer("ab cd ab  abc\ncd".encode() * 1, np.uint8)
    h = word_hashes(raw, *word_spans(raw))
    assert h[0] == h[2]
    assert h[1] == h[4]
    assert len(set(h.tolist())) == 3
    long = np.frombuffer(("ab " * 300_000).encode(), np.uint8)
    assert set(word_hashes(long, *word_spans(long)).tolist()) == {h[0]}
    assert len(gram_hashes(h, 6)) == 0


def brute_substrings(rows, depth=20):
    seen, removed = {}, {}
    for doc, text in sorted(rows):
        w = words(text)
        for s in range(len(w) - depth + 1):
            key = tuple(w[s : s + depth])
            if key in seen:
                removed.setdefault(doc, set()).update(range(s, s + depth))
            seen.setdefault(key, (doc, s))
    return {doc: (len(words(t)), len(removed.get(doc, ())), hashlib.sha256(b" ".join(x for i, x in enumerate(words(t)) if i not in removed.get(doc, ()))).hexdigest()) for doc, t in rows}


def test_substring_dedup(docs, empty):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_substrings(TEXTS)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_repeated_and_null_ids(spark):
    rows = spark.createDataFrame([(1, BASE), (1, BASE), (None, BASE), (1, prose(50, 9))], "doc_id long, text string")
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(rows).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 0), (None, 200), (1, 0)], key=str)


def test_prefix_groups_are_bounded():
    w = np.array([1, 1, 1, 2, 1, 1, 1, 3, 2, 2, 1, 1] * 20, np.uint64)
    starts = np.arange(len(w) - 4)
    parts = list(substring_dedup.prefix_groups(w, starts, 4, 30))
    assert sorted(np.concatenate(parts).tolist()) == starts.tolist()
    for part in parts:
        assert len(part) <= 30 or len({tuple(w[s : s + 4]) for s in part}) == 1


def test_exact_dedup(docs, empty, spark):
    key = lambda t: "".join((t or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"}))
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(key(t), []).append((-len(t or ""), i))
    expected = {i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()} == expected
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in expected.items() if x[2]}
    null = spark.createDataFrame([(None, "a"), (None, "a"), (3, "b")], "doc_id long, text string")
    assert sorted((r.group_size, r.kept) for r in exact_dedup.exact_groups(null).collect()) == [(1, True), (2, True), (2, True)]


def test_cuckoo_index_grows_and_deletes():
    index = exact_dedup.CuckooIndex(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.insert(k, i)
    assert index.resizes > 0
    assert all(index.find(k) == i for i, k in enumerate(keys))
    assert index.find(b"\0" * 32) is None
    assert all(index.delete(k) for k in keys[::2])
    assert not index.delete(keys[0])
    assert [index.find(k) for k in keys[:4]] == [None, 1, None, 3]
    assert index.live == 2500


def brute_links(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, empty, width, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert got == brute_links(TEXTS, width, percent)
    if width == 5:
        assert minhash.near_duplicates(empty, width, percent).count() == 0


def test_near_duplicate_chain_is_followed(spark):
    w = prose(120, 11).split()
    rows = [(i, " ".join([f"edit{i}{k}" if k < 3 * i else x for k, x in enumerate(w)])) for i in range(12)] + [(100 + i, prose(8, 50 + i)) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == brute_links(rows, 3, 85)


def test_registers_estimate_similarity():
    rnd = np.random.default_rng(1)
    pool = np.unique(rnd.integers(0, 1 << 63, 4000).astype(np.uint64))
    a, b = np.sort(pool[:2000]), np.sort(pool[200:2200])
    share = (minhash.registers(a) == minhash.registers(b)).mean()
    assert abs((share - minhash.COLLISIONS) / (1 - minhash.COLLISIONS) - 1800 / 2200) < 0.15


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (4, 3)], "u long, v long")
    assert {(r.u, r.v) for r in components(edges).collect()} == {(2, 1), (3, 1), (4, 1), (9, 8)}


def test_mixing(spark, docs, empty):
    rows = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes = {i: len(words(t)) for i, t in TEXTS}
    assert {i: r.size for i, r in rows.items()} == sizes
    by_source = {}
    for r in rows.values():
        by_source.setdefault(r.source, []).append(r)
    order = sorted(s for s in by_source if s is not None) + [None]
    total, weight = sum(sizes.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    own = {s: sum(r.size for r in by_source[s]) for s in order}
    capped: set = set()
    while True:
        rest = total - sum(3 * own[s] for s in capped)
        share = {s: weight[s] * rest / sum(weight[x] for x in order if x not in capped) for s in order if s not in capped}
        over = {s for s, x in share.items() if x > 3 * own[s]}
        if not over:
            break
        capped |= over
    for s in order:
        target = 3 * own[s] if s in capped else share[s]
        assert {round(r.target, 6) for r in by_source[s]} == {round(target, 6)}
        assert abs(sum(r.taken for r in by_source[s]) - target) < 1
        assert all(r.taken <= 3 * r.size for r in by_source[s])
    assert sorted((r.doc_id, r.taken) for r in rows.values()) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert mixing.mix(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.text for r in mixed.collect()} <= {t for _, t in TEXTS}


def test_warc(spark, empty):
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/", body), (2, "http://b/ é", body), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", body), (6, "u", "z" * 600_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    bundles = warc.write_archives(pages)
    got = {r.page_id: r for r in warc.read_archives(bundles).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 4: ("response", None), 5: ("response", None), None: ("revisit", 1), 6: ("response", None)}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
    stored = {r.bundle: r.content for r in bundles.collect()}
    for entry in warc.record_index(bundles).collect():  # one record by one frame
        fields, _, end = warc.decode_record(warc.read_frame(bytes(stored[entry.bundle]), entry.frame), entry.offset)
        assert fields["WARC-Record-ID"] == entry.record_id
        assert end - entry.offset == entry.length
    import io

    import zstandard

    for content in stored.values():  # any Zstandard reader sees the records in a row
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(content)), read_across_frames=True).read().count(b"WARC/1.1\r\n") >= 1
    assert warc.read_archives(warc.write_archives(empty.selectExpr("doc_id AS page_id", "text AS url", "text AS html"))).count() == 0


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "a\\<s>b"), (1, 0, "user", said), (2, 0, None, None), (1, 2, "assistant", said), (3, 0, "user<|body|>", "<|turn|>\\"), (1, 1, "assistant", "a\\<s>b"), (None, 0, "user", "x")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")).collect()}
    assert chat.parse(got[1].formatted) == [("user", said), ("assistant", "a\\<s>b"), ("assistant", "a\\<s>b"), ("assistant", said)]
    assert chat.parse(got[2].formatted) == [("", "")]
    assert chat.parse(got[3].formatted) == [("user<|body|>", "<|turn|>\\")]
    assert got[1].formatted.count("</s>") == 4
    assert "".join(chat.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss_spans) == "a\\<s>b" * 2 + said
    with open(chat.VOCABULARY, "rb") as f:
        encode, base = chat.load_encoder(f.read())
    masked = [i for i, m in zip(got[1].ids, got[1].loss_mask, strict=True) if m]
    assert masked == [t for x in ("a\\<s>b", "a\\<s>b", said) for t in encode(chat.escape(x))]
    assert [i for i in got[1].ids if i >= base].count(base + chat.RESERVED[chat.END]) == 4
    assert len(got) == 4


def test_toxicity_restores_disguises_and_ranks(spark):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        w = prose(40, 1000 + i).split()
        toxic = i % 5 == 0
        if toxic:
            w[rnd.randrange(40)] = rnd.choice(["wretch", "numbskull"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    disguised = ["wr3tch", "w r e t c h", "n-u-m-b-s-k-u-l-l", "wwwretch", "numb5kull!!"]
    rows += [(1000 + i, prose(20, 2000 + i) + " " + x + " " + prose(20, 3000 + i)) for i, x in enumerate(disguised)] + [(2000, None), (2001, ""), (None, "plain")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "id long, toxic int")).collect()}
    clean = max(got[i].score for i, t in labels if not t)
    assert all(got[i].predicted == 1 for i, t in labels if t)
    assert clean < 0.5
    assert [got[1000 + i].predicted for i in range(5)] == [1] * 5
    assert 0 <= got[2000].score == got[2001].score < 0.5
    assert got[None].held_out is None
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([], "id long, toxic int")).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://WWW.Example.com/en/x"), (2, "http://a.example.com/en/"), (3, "http://a.com"), (4, "https://b.net/es/1?q"), (5, "https://b.net/de/"), (6, None), (7, "no url"), (8, "http://bad.org/x"), (9, "http://notexample.com/en/1"), (10, "http://h#f")]
    rows += [(100 + i, f"http://bad.org/{i}") for i in range(30)] + [(200 + i, f"http://good.org/{i}") for i in range(30)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(200 + i, 0) for i in range(30)] + [(3, None)], "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3] == ("a.com", "", None, "allow")
    assert got[4] == ("b.net", "/es/1", "net/es/", "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][3] == "block"
    assert got[200][3] == "allow"
    assert got[9] == ("notexample.com", "/en/1", "com/", "allow")
    assert got[10][:2] == ("h", "")
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_url_reputation_shrinks(spark):
    rows = [("a.x.org", 1)] + [("b.x.org", 0)] * 50 + [("c.y.co.uk", 1)] * 50
    got = {r.host: r for r in url_filter.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert (got["c.y.co.uk"].domain, got["c.y.co.uk"].suffix) == ("y.co.uk", "co.uk")
    assert got["b.x.org"].mean < got["a.x.org"].mean < 0.6
    assert all(0 <= r.lower <= r.mean <= 1 for r in got.values())


def test_top_k(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.normal(size=10).round(1)]) for i in range(230)] + [(300, None), (301, [float("nan")] * 10), (302, [None] + [1.0] * 9), (303, [float("inf")] * 10), (None, [1.0] * 10)]
    rows += [(i + 400, rows[i][1]) for i in range(20)]  # ties
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    good = {i: np.floor(256 * np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in (i for i in good if i % 50 == 0):
        best = sorted((-int(good[q] @ good[c]), c) for c in good if c != q)[:5]
        expected += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in topk_search.top_k(df).collect()) == sorted(expected)
    assert topk_search.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.top_k(few).collect()] == [(0, 1, 1, 0)]


def test_sentencepiece(spark, docs, empty):
    import sentencepiece as library

    model = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    pieces = sentencepiece.Pieces()
    texts = ["a  b\nc\td   e ", "ﬁ ① é", "▁a b", "<s> <0x0A>", "x" * 500, " " * 40 + "y", "日本語テスト", "naïve café 😀", "a" + " " * 17 + "b", "word" * 30]
    for text in texts:
        ids = [i for w in sentencepiece.words_of(text) for i in pieces.encode_word(w)]
        assert ids == model.encode(text)
        assert pieces.decode(ids) == model.decode(ids)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string"))
    known = dict(TEXTS) | dict(enumerate(texts, 100))
    for r in sentencepiece.encode_documents(more, dictionary=50).collect():
        assert list(r.ids) == (model.encode(known[r.doc_id]) if known[r.doc_id] else [])
        assert r.round_trip
    assert sentencepiece.encode_documents(empty).count() == 0


def test_viterbi_fold_finds_the_best_path(spark):
    table = {"a": -2.0, "b": -2.0, "ab": -3.5, "abc": -9.0, "bc": -1.0, "c": -5.0, "▁": -1.0, "▁a": -2.5}
    pieces = spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(table.items())], "piece string, id int, score double")
    rows = sentencepiece.lattice(spark.createDataFrame([("▁abc",), ("abab",), ("xb",)], "word string"), pieces, 3)
    got = {r.word: r.cuts for r in rows.select("word", sentencepiece.viterbi_fold(F.col("word"), F.col("edges")).alias("cuts")).collect()}
    for word, cuts in got.items():
        assert [word[a - 1 : b - 1] for a, b in zip(cuts, cuts[1:], strict=False)] == sentencepiece._viterbi(word, {p: (0, s) for p, s in table.items()}, 3)
