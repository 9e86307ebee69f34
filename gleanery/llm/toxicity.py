"""Toxicity scoring behind a noisy-channel deobfuscator.

A character trigram model is counted over the words of all documents. Tokens that look disguised (look-alike
characters among letters, letters repeated three times or more, runs of single letters, separators between
letters) become lattices: each character may stand for itself or for the letters it resembles, repeats may
shrink, separators may vanish or end a word. A Viterbi search over the lattice finds the most likely reading
under channel and model, and takes the token's place. The restored words and their prefixes are
the features of a logistic regression fitted on at most TRAIN_ROWS labelled documents (the bound is the
parameter `train_rows`); features are picked by the lower bound of their log odds on these rows.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, text_bytes, word_hashes, word_spans

TRAIN_ROWS = 8192
FEATURES = 4096
PREFIXES = (3, 4, 5, 6, 7, 8, 0)  # bytes; 0: the whole word
MIN_POSITIVE = 3

# Letters that a character may stand for in leetspeak.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "*": "aeiou", "#": "h", "%": "x", "&": "e",
}
SEPARATORS = ".-_*~'"

LEET_COST, SHRINK_COST, PAIR_COST, SEPARATOR_COST, BREAK_COST, LITERAL_COST = 1.0, 0.4, 2.5, 0.7, 2.0, 6.0
CLASSES = 28  # 0: outside a word, 1-26: a-z, 27: any other letter
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = np.arange(1, 27)
_CLASS[128:] = 27
_TRIM_LEFT = re.compile(r"^[\"'`(\[{<«»„“”.,;:?\-_*~#%&=/\\]+(?=[^\W_]|[@$!|+(]\w)")
_TRIM_RIGHT = re.compile(r"[^\w]+$|_+$")
_PLAIN = np.zeros(256, bool)
_PLAIN[ord("a") : ord("z") + 1] = True
_PLAIN[128:] = True
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "\"'`()[]{},;:?.!#$%&*=/\\<>|~^+-_@"]] = True


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def trigram_counts(data: bytes) -> np.ndarray:
    """Counts of character class triples in lower-case UTF-8 text."""
    c = _CLASS[np.frombuffer(b"\n\n" + data + b"\n\n", np.uint8)].astype(np.int32)
    return np.bincount(c[:-2] * (CLASSES * CLASSES) + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), interpolated with the bigram and unigram models."""
    tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    bi, uni = tri.sum(0), tri.sum((0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 20 * p1) / (bi.sum(1, keepdims=True) + 20)
    return np.log((tri + 10 * p2[None]) / (tri.sum(2, keepdims=True) + 10))


def arcs_of(ch: str, n: int) -> list[tuple[str, float]]:
    """Readings of a run of n equal characters, and their costs."""
    arcs: list[tuple[str, float]] = []
    if ch == " ":
        arcs = [("", 0.2 if n == 1 else 2.0), (" ", BREAK_COST)]
    elif ch in SEPARATORS:
        arcs = [("", SEPARATOR_COST), (" ", BREAK_COST)]
    elif ch.isalpha():
        arcs = [(ch, (0.0, PAIR_COST, SHRINK_COST)[min(n, 3) - 1])] + ([(ch * 2, 0.0 if n == 2 else SHRINK_COST)] if n > 1 else [])
    for letter in LOOKALIKES.get(ch, ""):
        arcs += [(letter, LEET_COST)] + ([(letter * 2, LEET_COST + SHRINK_COST)] if n > 1 else [])
    if not arcs or (not ch.isalpha() and ch not in " " + SEPARATORS):
        arcs.append((ch * n, LITERAL_COST))
    return arcs


def decode(token: str, model: np.ndarray) -> str:
    """The most likely reading of one token or run of spaced letters; a space in it ends a word. Each state keeps its best
    cost and a pointer to the step before it."""
    states: dict = {(0, 0): (0.0, None)}
    for m in re.finditer(r"(.)\1*", token, re.S):
        arcs = [(out, price, [_class(c) for c in out]) for out, price in arcs_of(m[1], len(m[0]))]
        new: dict = {}
        for (a, b), (cost, path) in states.items():
            for out, price, classes in arcs:
                x, y, total = a, b, cost + price
                for z in classes:
                    total -= model[x, y, z]
                    x, y = y, z
                old = new.get((x, y))
                if old is None or total < old[0]:
                    new[x, y] = (total, (path, out))
        states = new
    path = min(((cost - model[a, b, 0], path) for (a, b), (cost, path) in states.items()), key=lambda s: s[0])[1]
    out = []
    while path is not None:
        path, last = path
        out.append(last)
    return "".join(reversed(out))


def restored(text: str, model: np.ndarray, cache: dict) -> bytes:
    """Lower-case UTF-8 text with its disguised tokens replaced by their most likely readings."""
    data = text.lower().encode()
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return b""
    plain = np.concatenate([[0], np.cumsum(_PLAIN[raw])])
    triple = np.zeros(len(raw) + 1, np.int64)
    if len(raw) > 2:
        same = (raw[:-2] == raw[1:-1]) & (raw[1:-1] == raw[2:]) & (_PLAIN[raw[:-2]])
        triple[3:] = np.cumsum(same)
    trailing = _trailing(raw, starts, ends)
    letters = plain[ends] - plain[starts]
    single = ends - starts == 1
    run = np.diff(np.concatenate([[0], single.astype(np.int8), [0]]))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1)
    spaced = [(a, b) for a, b in zip(first, last, strict=True) if b - a >= 3 and len(set(data[starts[a] : ends[b - 1] : 2])) > 1]
    odd = ((letters < ends - starts - trailing) | (triple[ends] - triple[np.minimum(starts + 2, ends)] > 0)) & (letters > 0) & ~single
    replace = [(int(starts[i]), int(ends[i])) for i in np.flatnonzero(odd)] + [(int(starts[a]), int(ends[b - 1])) for a, b in spaced]
    out, at = [], 0
    for a, b in sorted(replace):
        if a < at:
            continue
        token = data[a:b].decode()
        new = cache.get(token)
        if new is None:
            core = _TRIM_RIGHT.sub("", _TRIM_LEFT.sub("", token))
            new = decode(re.sub(r"\s", " ", core), model).encode() if not core.isalpha() or re.search(r"(.)\1\1", core) else core.encode()
            if len(cache) < 200_000:  # only what is remembered is bounded
                cache[token] = new
        out += [data[at:a], new]
        at = b
    return b"".join([*out, data[at:]])


def _trailing(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Edge characters at the end of each word."""
    last = np.maximum.accumulate(np.where(~_EDGE[raw], np.arange(len(raw)), -1))
    return ends - 1 - np.maximum(last[ends - 1], starts - 1)


def features(data: bytes) -> np.ndarray:
    """Distinct hashes of the restored words and their prefixes, edge characters removed."""
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, np.uint64)
    ends = ends - _trailing(raw, starts, ends)
    some = ends > starts
    starts, ends = starts[some], ends[some]
    made = []
    for k in PREFIXES:
        long = ends - starts > k if k else np.ones(len(starts), bool)
        a = starts[long]
        made.append(mix64(word_hashes(raw, a, a + k if k else ends) + np.uint64(k + 1)))
    return np.unique(np.concatenate(made))


def _count_trigrams(batches):
    total = np.zeros(CLASSES**3, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                total += trigram_counts(text.lower().encode())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The trigram model of all documents; at most CLASSES**3 counts reach the driver."""
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_trigrams, "gram int, n long")
    found = counts.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(CLASSES**3)
    total[found["gram"].to_numpy()] = found["n"].to_numpy()
    return log_model(total)


def _with_features(model):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            made = [features(restored(t or "", model.value, cache)).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["toxic", "features"])

    return run


def _picked(lexicon: np.ndarray):
    def run(batches):
        for batch in batches:
            made = [np.flatnonzero(np.isin(lexicon, f)).astype(np.int32) for f in (np.array(x, np.int64) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["toxic", "at"])

    return run


def fit_logistic(rows: list[np.ndarray], labels: np.ndarray, n: int, penalty: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a regularised logistic regression on sparse binary rows, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    weight, bias = np.zeros(n), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    if not len(col):
        return weight, bias
    rate = 4.0 / (np.bincount(at, minlength=len(rows)) * np.bincount(at, minlength=len(rows))).mean() ** 0.5 / max(1.0, np.bincount(col).max() / 4)
    seen_w, seen_b, old_w, old_b = weight, bias, weight, bias
    for step in range(steps):
        z = np.bincount(at, seen_w[col], len(rows)) + seen_b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        new_w = seen_w - rate * (np.bincount(col, error[at], n) + penalty * seen_w)
        new_b = seen_b - rate * error.sum()
        push = step / (step + 3)
        seen_w, seen_b = new_w + push * (new_w - old_w), new_b + push * (new_b - old_b)
        old_w, old_b = new_w, new_b
    return old_w, float(old_b)


def train(docs: DataFrame, labels: DataFrame, model: np.ndarray, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text"):
    """(sorted feature hashes, weights, bias) from labelled rows (id, toxic) with crc32(id) mod 5 other than 0.

    Of these, the `train_rows` least by a hash of the id are taken, and of equal texts one.
    """
    spark = docs.sparkSession
    known = labels.where("toxic IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.where(~held_out(F.col("id"))).orderBy(F.xxhash64(F.lit(17), "id"), "id").limit(train_rows)
    sample = materialise(sample.withColumnRenamed("id", "__id"), "labels")
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))  # at most train_rows rows
    rows = rows.withColumn("__key", F.xxhash64("text")).dropDuplicates(["__key"]).select("toxic", "text")
    made = materialise(rows.mapInArrow(_with_features(spark.sparkContext.broadcast(model)), "toxic int, features array<long>"), "features")
    n, pos = (float(x or 0) for x in made.agg(F.count("*"), F.sum("toxic")).first())
    neg = n - pos
    if not pos or not neg:
        return np.zeros(0, np.uint64), np.zeros(0), math.log((pos + 1) / (neg + 1))
    p, q = F.col("p") + F.lit(0.5), F.col("n") - F.col("p") + F.lit(0.5)
    odds = F.log(p / (F.lit(pos) - F.col("p") + F.lit(0.5))) - F.log(q / (F.lit(neg) - F.col("n") + F.col("p") + F.lit(0.5)))
    lower = odds - F.lit(1.5) * F.sqrt(F.lit(1.0) / p + F.lit(1.0) / q)
    counted = made.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.count("*").alias("n"), F.sum("toxic").alias("p")).where(F.col("p") >= MIN_POSITIVE)
    best = counted.withColumn("lower", lower).where("lower > 0.7").orderBy(F.col("lower").desc(), "f").limit(FEATURES).select("f")
    lexicon = np.sort(best.toArrow()["f"].to_numpy().view(np.uint64))
    chosen = made.mapInArrow(_picked(lexicon.view(np.int64)), "toxic int, at array<int>").toArrow()  # at most train_rows rows
    weight, bias = fit_logistic([np.array(x, np.int64) for x in chosen["at"].to_pylist()], chosen["toxic"].to_numpy().astype(float), len(lexicon))
    return lexicon, weight, bias


def _scored(texts: list, value: tuple, cache: dict) -> list[float]:
    model, lexicon, weight, bias = value
    out = []
    for text in texts:
        z = bias
        if len(lexicon) and text:
            found = features(restored(text, model, cache))
            at = np.searchsorted(lexicon, found)
            at[at == len(lexicon)] = 0
            z += weight[at[lexicon[at] == found]].sum()
        out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
    return out


def _scores(shared):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            out = _scored(batch.column(1).to_pylist(), shared.value, cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return run


def _clean(shared, text_at: int):
    def run(batches):
        cache: dict = {}
        for batch in batches:
            out = _scored(batch.column(text_at).to_pylist(), shared.value, cache)
            yield batch.filter(pa.array([x < 0.5 for x in out], pa.bool_()))

    return run


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def _fitted(docs: DataFrame, labels: DataFrame, train_rows: int, id_col: str, text_col: str):
    model = character_model(docs, text_col)
    return docs.sparkSession.sparkContext.broadcast((model, *train(docs, labels, model, train_rows, id_col, text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; labels has (id, toxic 0/1).

    Null and empty texts get the score of a text without features. Without labelled rows of both kinds every
    score is the smoothed share of the kind that there is. held_out is null where doc_id is. Repeated rows get
    equal scores; other columns are ignored; texts are read whole; an empty table gives an empty table.
    """
    shared = _fitted(docs, labels, train_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(_scores(shared), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text `toxicity` predicts as toxic; all columns stay. Each row is judged where it
    stands, so that null and repeated ids don't matter."""
    shared = _fitted(docs, labels, train_rows, id_col, text_col)
    return docs.mapInArrow(_clean(shared, docs.columns.index(text_col)), docs.schema)


def op3_toxicity(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
