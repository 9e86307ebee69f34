"""SentencePiece encoding and decoding through a relational lattice.

Texts are normalised (a leading blank, blanks shown as U+2581) and cut into words: a run of blanks and what follows
it. No piece has a blank behind another character, so words are encoded independently. The DICTIONARY most frequent
words of the corpus are encoded relationally: their substrings of bounded length are exploded and equi-joined to the
piece table, which gives the lattice's edges; edges are grouped by word and folded with Spark's `aggregate`.

For a unigram model the fold is Viterbi: the best score of each end position. The public model here is a BPE
model, whose scores are merge ranks and not log probabilities: its encoding is no best path, so the fold
then applies the best-scored merge of two neighbouring segments, leftmost first, until none is left. That gives the
reference library's ids; Viterbi wouldn't.

The encoded dictionary (bounded by DICTIONARY words of at most LONGEST characters) is broadcast. Rarer and longer words
are encoded where they stand by the same merges over the same piece table, not through the lattice: the lattice over all
distinct words is right too, but costs more than the check tool's budget allows (README has the figures).
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY = 1 << 18
LONGEST = 32
MASKED = 61  # characters whose places fit a long
BLANK = "▁"
_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")

UNIGRAM, BPE = "unigram", "bpe"


class Pieces:
    """The piece table of a model: normal pieces with id and score, and the ids of byte and control pieces."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.table = {self.names[i]: (i, model.get_score(i)) for i in range(n) if not special[i] and not model.is_byte(i) and not model.is_unused(i)}
        self.width = max(map(len, self.table))
        scores = [s for _, s in self.table.values()]
        # merge ranks are whole numbers; log probabilities aren't
        self.kind = BPE if all(float(s).is_integer() for s in scores) else UNIGRAM
        value = [b"" if s else name.replace(BLANK, " ").encode() for name, s in zip(self.names, special, strict=True)]
        for byte, i in self.bytes.items():
            value[i] = bytes([byte])
        value[self.unknown] = " ⁇ ".encode()
        self.value = value
        self.rank = {p: -score for p, (_, score) in self.table.items()}
        self.pairs = {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}
        self.late = {p for p in self.table if self.kind == BPE and len(p) > 1 and not self._whole(p)}

    def single(self, ch: str) -> list[int]:
        """Ids of one character: its piece, else its bytes, else unknown."""
        known = self.table.get(ch)
        if known:
            return [known[0]]
        return [self.bytes[b] for b in ch.encode()] if len(self.bytes) == 256 else [self.unknown]

    def _whole(self, piece: str) -> bool:
        """Whether merging a piece's characters by pieces of better rank, each in its turn, gives the piece."""
        spans = [(self.rank[part], i, j) for i in range(len(piece)) for j in range(i + 2, len(piece) + 1) if (part := piece[i:j]) in self.rank]
        places = (1 << len(piece) + 1) - 1
        for rank, i, j in sorted(spans):
            inside = places & ((1 << j) - (1 << i + 1))
            if rank <= self.rank[piece] and places >> i & 1 and places >> j & 1 and inside.bit_count() == 1:
                places -= inside
        return places == 1 | 1 << len(piece)

    def ids_of(self, parts: list[str]) -> list[int]:
        """Ids of a word's segments."""
        return [i for p in parts for i in ([self.table[p][0]] if p in self.table else [j for ch in p for j in self.single(ch)])]

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, late."""
        table = pa.table({"piece": list(self.table), "id": pa.array([i for i, _ in self.table.values()], pa.int32()), "score": pa.array([s for _, s in self.table.values()], pa.float64()), "late": [p in self.late for p in self.table]})
        return spark.createDataFrame(table)

    def encode_word(self, word: str) -> list[int]:
        """The fold over one word in place. In long words, neighbours that no piece holds side by side are cut first."""
        if self.kind == BPE and len(word) <= LONGEST * 2:
            return self.ids_of(_merge_short(word, self.rank))
        parts, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.pairs:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        fold = _merge if self.kind == BPE else _viterbi
        return [i for part in parts for i in self.ids_of(fold(part, self.table, self.width))]

    def decode(self, ids) -> str:
        text = b"".join([self.value[i] for i in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _merge_short(word: str, rank: dict) -> list[str]:
    """As _merge, by the least rank of a list of neighbours: quicker for words of a few dozen characters."""
    get, none = rank.get, float("inf")
    parts = list(word)
    ranks = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while ranks:
        least = min(ranks)
        if least == none:
            break
        i = ranks.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del ranks[i]
        if i:
            ranks[i - 1] = get(parts[i - 1] + parts[i], none)
        if i < len(ranks):
            ranks[i] = get(parts[i] + parts[i + 1], none)
    return parts


def _merge(word: str, table: dict, _width: int) -> list[str]:
    """Best-scored merges of neighbouring segments, leftmost first, by a heap over a linked list."""
    if word in table and len(word) <= 2 or len(word) == 1:
        return [word]
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(-table[p][1], i, p) for i in range(len(parts) - 1) if (p := word[i : i + 2]) in table]
    heapq.heapify(heap)
    while heap:
        _, i, piece = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != piece:
            continue
        parts[i], parts[j] = piece, None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < len(parts) and (p := parts[a] + parts[b]) in table:
                heapq.heappush(heap, (-table[p][1], a, p))
    return [p for p in parts if p is not None]


def _viterbi(word: str, table: dict, width: int) -> list[str]:
    best = [(0.0, 0)] + [(-1e18, 0)] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - width), end):
            known = table.get(word[start:end])
            score = best[start][0] + (known[1] if known else -1e6 if end - start == 1 else -1e18)
            if score > best[end][0]:
                best[end] = (score, start)
    out, end = [], len(word)
    while end:
        out.append(word[best[end][1] : end])
        end = best[end][1]
    return out[::-1]


def words_of(text: str) -> list[str]:
    return _WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []


def keys_of(text: str) -> list[str]:
    """A text's words, the one blank in front of most of them left out: a key that doesn't start with U+2581 stands behind one."""
    if BLANK not in text and "  " not in text and not text.startswith(" ") and not text.endswith(" "):
        return text.split(" ") if text else []
    return [w[1:] if len(w) > 1 and w[1] != BLANK else w for w in words_of(text)]


def _count_words(batches):
    from collections import Counter

    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(keys_of(text or ""))
        if len(found) > 400_000:
            yield _counted(found)
            found = Counter()
    yield _counted(found)


def _counted(found) -> pa.RecordBatch:
    kept = [(w if w.startswith(BLANK) else BLANK + w, n) for w, n in found.items() if len(w) < LONGEST]
    return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])


def frequent_words(docs: DataFrame, n: int = DICTIONARY, text_col: str = "text") -> DataFrame:
    """At most n words of at most LONGEST characters: all those whose count over all documents reaches a threshold.

    The threshold comes from a histogram of counts in steps of a 64th of a doubling, some 4,000 rows at most; nothing is sorted.
    """
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "word string, n long")
    counts = materialise(counts.groupBy("word").agg(F.sum("n").alias("n")), "counts").withColumn("step", F.floor(F.log2("n") * 64))
    total, least = 0, None
    for step, words in sorted(map(tuple, counts.groupBy("step").agg(F.count("*").alias("words")).collect()), reverse=True):
        total += words
        if total > n:
            break
        least = step
    return counts.where(F.col("step") >= least).select("word") if least is not None else counts.limit(0).select("word")


def lattice(words: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """word, edges array<struct<i, l, score, id>>: all substrings that are pieces, grouped by word.

    The piece table is the vocabulary, whose size the model file bounds. Words are exchanged once, before the explosion.
    """
    edges = _edges(words, pieces, width)
    edge = F.when(F.col("id").isNotNull(), F.struct("i", "l", "score", "id"))
    return edges.groupBy("word").agg(F.collect_list(edge).alias("edges"))


def merge_lattice(words: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """word, edges array<struct<rank, i, ends, inner, late>> of the pieces of two characters or more: the places between characters
    at their ends and inside, as bits. Words have MASKED characters at most."""
    edges = _edges(words, pieces, width)
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    i, l = F.col("i"), F.col("l")  # noqa: E741
    edge = F.struct((-F.col("score")).alias("rank"), "i", (bit(i - 1) + bit(i - 1 + l)).alias("ends"), (bit(i + l - 1) - bit(i)).alias("inner"), "late")
    return edges.groupBy("word").agg(F.collect_list(F.when(F.col("id").isNotNull() & (l > 1), edge)).alias("edges"))


def _edges(words: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    length = F.length("word")
    spans = F.flatten(
        F.transform(F.sequence(F.lit(1), length), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(width), length - i + 1)), lambda n: F.struct(i.alias("i"), n.alias("l"))))
    )
    parts = words.repartition(partitions(words.sparkSession), "word").select("word", F.explode(spans).alias("s")).select("word", "s.i", "s.l", F.substring("word", F.col("s.i"), F.col("s.l")).alias("part"))
    return parts.join(F.broadcast(pieces), F.col("part") == F.col("piece"), "left")


def rank_fold(word: Column, edges: Column) -> Column:
    """The places between a word's segments after all merges, as bits, by one aggregate over its edges, best score first, leftmost first.

    A merge happens if both ends of the piece are places and one place is inside. One turn is enough for pieces that come out
    whole when they are merged by themselves with better-ranked pieces alone: where such a piece's span is not crossed, its own
    merges come before its turn. Others are `late`, and words that hold one are left to merge_fold.
    """
    start = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(word) + 1) - 1

    def step(places: Column, e: Column) -> Column:
        inside = places.bitwiseAND(e["inner"])
        merges = (places.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(inside) == 1)
        return F.when(merges, places - inside).otherwise(places)

    return F.aggregate(F.array_sort(edges), start, step)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _next(cuts: Column, at: Column, step: int) -> Column:
    return F.get(cuts, F.array_position(cuts, at).cast("int") - 1 + step)


def merge_fold(word: Column, edges: Column) -> Column:
    """Cut positions of a word's segments after all merges, by one aggregate over its characters."""
    start = F.sequence(F.lit(1), F.length(word) + 1)
    none = F.lit(None).cast("struct<score:double,j:int,mid:int>")

    def step(cuts: Column, _: Column) -> Column:
        fits = F.filter(edges, lambda e: (e["l"] > 1) & F.array_contains(cuts, e["i"]) & F.coalesce(_next(cuts, e["i"], 2) == e["i"] + e["l"], F.lit(False)))
        best = F.coalesce(F.array_max(F.transform(fits, lambda e: F.struct(e["score"].alias("score"), (-e["i"]).alias("j"), _next(cuts, e["i"], 1).alias("mid")))), none)
        return _let(best["mid"], lambda mid: F.when(mid.isNull(), cuts).otherwise(F.array_remove(cuts, mid)))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step)


def viterbi_fold(word: Column, edges: Column) -> Column:
    """Cut positions of the best path, by one aggregate over end positions; the state holds score and path of each end."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.array(F.lit(1)).alias("path")))

    def step(best: Column, end: Column) -> Column:
        known = F.transform(F.filter(edges, lambda e: e["i"] + e["l"] == end + 1), lambda e: F.struct((F.get(best, e["i"] - 1)["score"] + e["score"]).alias("score"), F.concat(F.get(best, e["i"] - 1)["path"], F.array(end + 1)).alias("path")))
        last = F.element_at(best, -1)
        lone = F.struct((last["score"] - F.lit(1e6)).alias("score"), F.concat(last["path"], F.array(end + 1)).alias("path"))
        return F.concat(best, F.array(F.array_max(F.concat(known, F.array(lone)))))

    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda best: F.element_at(best, -1)["path"])


def _named(shared):
    """word, ids from word and either places (bits) or cuts."""

    def run(batches):
        pieces = shared.value
        for batch in batches:
            made = []
            for word, places, cuts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = [i for i in range(len(word) + 1) if places >> i & 1] if places is not None else [c - 1 for c in cuts]
                made.append(pieces.ids_of([word[a:b] for a, b in zip(at, at[1:], strict=False)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word, ids array<int> through the relational lattice. A character outside the pieces gives its bytes' ids.

    Of a BPE model, words beyond MASKED characters or with a late piece take the fold over arrays of cuts.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    none = F.lit(None)
    table = pieces.frame(spark)
    if pieces.kind == UNIGRAM:
        rows = lattice(words, table, pieces.width)
        found = rows.select("word", none.cast("long").alias("places"), viterbi_fold(F.col("word"), F.col("edges")).alias("cuts"))
    else:
        # written before use, as the optimiser would repeat the fold in each place that reads its result
        short = merge_lattice(words.where(F.length("word") <= MASKED), table, pieces.width)
        late = F.exists("edges", lambda e: e["late"])
        folded = materialise(short.select("word", F.when(~late, rank_fold(F.col("word"), F.col("edges"))).alias("places")), "places")
        rest = folded.where("places IS NULL").select("word").unionByName(words.where(F.length("word") > MASKED).select("word"))
        cut = lattice(rest, table, pieces.width).select("word", none.cast("long").alias("places"), merge_fold(F.col("word"), F.col("edges")).alias("cuts"))
        found = folded.where("places IS NOT NULL").withColumn("cuts", none.cast("array<int>")).unionByName(cut)
    return found.mapInArrow(_named(shared), "word string, ids array<int>")


def _encoded(shared, keep: bool):
    def run(batches):
        pieces, known = shared.value
        known = dict(known)
        room = len(known) + 300_000
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                parts = []
                for word in keys_of(text or ""):
                    ids = known.get(word)
                    if ids is None:
                        ids = np.array(pieces.encode_word(word if word.startswith(BLANK) else BLANK + word), "<i4").tobytes()
                        if len(known) < room:  # only what is remembered is bounded
                            known[word] = ids
                    parts.append(ids)
                data = b"".join(parts)
                ids = np.frombuffer(data, "<i4")
                decoded = pieces.decode(ids.tolist())
                same = decoded == (text or "").replace(BLANK, " ")
                rows.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), same, ids if keep else None, decoded if keep else None))
            types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_pieces", "ids_sha256", "decoded_sha256", "round_trip", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=names)

    return run


def encode_documents(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", dictionary: int = DICTIONARY, keep: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_pieces, ids_sha256 (of little-endian int32), decoded_sha256, round_trip, ids, decoded.

    Null and empty texts have no pieces and decode to the empty text. A literal U+2581 decodes to a blank, as in the
    library; round_trip counts that as equal. Texts are encoded whole; repeated rows are kept; other columns are ignored;
    an empty table gives an empty table. `keep` False leaves ids and decoded null. The model file is read on the driver.
    """
    spark = docs.sparkSession
    pieces = Pieces(model)
    words = materialise(frequent_words(docs, dictionary, text_col), "words")
    table = materialise(encode_words(words, pieces), "encoded").toArrow()  # at most `dictionary` words
    known = {w[1:] if len(w) > 1 and w[1] != BLANK else w: np.array(ids, "<i4").tobytes() for w, ids in zip(table["word"].to_pylist(), table["ids"].to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast((pieces, known))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_encoded(shared, keep), f"doc_id {kind}, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean, ids array<int>, decoded string")


def op5_sentencepiece(spark, sf_dir):
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=False).drop("ids", "decoded")
