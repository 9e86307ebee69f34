"""Substring deduplication by suffix trees over groups of variable-length word prefixes, in buckets of minimisers.

A window is DEPTH consecutive words; one is a repeat if its word sequence also starts earlier (smaller id, or
same document and earlier start). Three passes:

1. Survey. Each window has a minimiser: the least hash of its GRAM-word runs. Equal windows have equal
   minimisers, so a window whose minimiser occurs once in the corpus can't be a repeat. About one minimiser in seven
   words is exchanged; those seen twice in a chunk of CHUNK_BYTES are settled there.
2. Suffixes. The words of surviving windows, cut into runs of one minimiser, go to that minimiser's bucket: a suffix by
   itself would carry its words DEPTH times over. They are settled in their own chunk, then in one of about the square root
   of the partitions' number of parts of their bucket, then in the bucket; each time only what comes first goes on, so that
   a passage that a third of all documents share meets in no task. Each time variable-length word prefixes split the
   suffixes into groups of at most GROUP (a prefix with too many is extended by a word), a group's suffix tree is made as
   suffix order and common prefix lengths, and its internal nodes of DEPTH words or more, nearest the root, are read off:
   their labels are the maximal repeats. Of the leaves below such a node all but the first are repeats.
3. Removal. Each document's words under a repeated window are dropped.

Word identity inside a bucket is a 64-bit hash of the word's bytes; sequences are compared word by word.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gram_hashes, materialise, mix64, partitions, release_shuffles, text_bytes, word_hashes, word_spans

DEPTH = 20
GRAM = 8
RUN = 64
LONGEST = 64  # words up to which common prefixes are told apart
GROUP = 1 << 20
CHUNK_BYTES = 8 << 20
_LAST_ID = (1 << 63) - 1

ROUTED = "route long, kind int, doc_id long, text_key long, data binary"
_NAMES = ["route", "kind", "doc_id", "text_key", "data"]
BUCKET, FOUND = 0, 1


def _slide(values: np.ndarray, width: int, fold) -> np.ndarray:
    """fold (minimum or maximum) over each run of `width` values, by doubling."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = fold(values[:-span], values[span:])
        span *= 2
    return fold(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def prefix_groups(words: np.ndarray, starts: np.ndarray, depth: int, bound: int):
    """Split suffixes by word prefixes into groups of at most `bound`; a larger one shares all `depth` words."""
    work = [(starts, 0)]
    while work:
        part, at = work.pop()
        if len(part) <= bound or at == depth:
            yield part
            continue
        part = part[np.argsort(words[part + at], kind="stable")]
        cuts = np.flatnonzero(np.diff(words[part + at])) + 1
        edges = np.concatenate([[0], cuts, [len(part)]])
        first = 0
        for i in range(1, len(edges)):
            if edges[i] - edges[i - 1] > bound:
                if edges[i - 1] > first:
                    work.append((part[first : edges[i - 1]], at))
                work.append((part[edges[i - 1] : edges[i]], at + 1))
                first = edges[i]
            elif edges[i] - first > bound:
                work.append((part[first : edges[i - 1]], at))
                first = edges[i - 1]
        if first < len(part):
            work.append((part[first:], at))


def subtree(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix tree of suffixes at `starts`, as their order and the longest common prefix of each with the one before it.

    `ends` tells where the run of words around each place ends; prefixes count up to `longest`, a power of two. Ranks of prefixes
    of doubled length are made from pairs of ranks; common prefixes are read off the ranks, longest first.
    """
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + longest, ends[starts]), -1)
    reach = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
    where = np.full(len(words), -1, np.int32)
    where[reach] = np.arange(len(reach), dtype=np.int32)
    stop = ends[reach]

    def moved(at: np.ndarray, step: int) -> np.ndarray:
        """Rows `step` words behind the rows `at`, -1 beyond the run."""
        place = reach[at] + step
        inside = (at >= 0) & (place < stop[at])
        return np.where(inside, where[np.where(inside, place, 0)], -1)

    def ranks(keys: np.ndarray) -> np.ndarray:
        return np.unique(keys, return_inverse=True)[1].astype(np.int64) + 1

    levels = [ranks(words[reach])]
    rows = np.arange(len(reach))
    while 1 << (len(levels) - 1) < longest:
        after = moved(rows, 1 << (len(levels) - 1))
        levels.append(ranks(levels[-1] << 32 | np.where(after >= 0, levels[-1][after], 0)))
    own = where[starts]
    order = np.argsort(levels[-1][own], kind="stable")
    a, b = own[order][:-1], own[order][1:]
    room = np.minimum(stop[a] - reach[a], stop[b] - reach[b])
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = (a >= 0) & (b >= 0) & (levels[k][a] == levels[k][b])
        common += same.astype(np.int64) << k
        a, b = np.where(same, moved(a, 1 << k), a), np.where(same, moved(b, 1 << k), b)
    return order, np.minimum(common, room)


def deep_nodes(common: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The internal nodes nearest the root that are `depth` words deep or more: first leaf, last leaf and string depth of each.
    A node's label is a repeat that can't be made longer without losing an occurrence."""
    deep = np.concatenate([[False], common >= depth, [False]])
    edge = np.flatnonzero(deep[1:] != deep[:-1])
    first, last = edge[::2], edge[1::2]
    bounds = np.column_stack([first, last]).ravel()
    lengths = np.minimum.reduceat(np.append(common, 0), bounds)[::2] if len(first) else common[:0]
    return first, last, lengths


def later_leaves(words: np.ndarray, ends: np.ndarray, starts: np.ndarray, ids: np.ndarray, places: np.ndarray, depth: int, bound: int) -> np.ndarray:
    """Which suffixes start later than another below the same deep node; ids and places give their order.

    A group of more than `bound` suffixes shares all `depth` words: it is one node's leaves.
    """
    late = np.zeros(len(starts), bool)
    where = np.zeros(len(words), np.int64)
    where[starts] = np.arange(len(starts))
    for part in prefix_groups(words, starts, depth, bound):
        if len(part) < 2:
            continue
        if len(part) <= bound:
            order, common = subtree(words, ends, part, LONGEST)
            first, last, _ = deep_nodes(common, depth)
            leaves = where[part[order]]
        else:
            first, last, leaves = np.array([0]), np.array([len(part) - 1]), where[part]
        sizes = last - first + 1
        node = np.repeat(np.arange(len(first)), sizes)
        at = leaves[np.arange(len(node)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)]
        by = np.lexsort((places[at], ids[at], node))
        at, node = at[by], node[by]
        fresh = np.concatenate([[True], node[1:] != node[:-1]])[: len(node)]
        head = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        late[at] = (ids[at] != ids[head]) | (places[at] != places[head])
    return late


class _Chunk:
    """Documents of about CHUNK_BYTES: their words' hashes in one array, and where each document's begin."""

    def __init__(self, ids, keys, raws, depth):
        self.ids, self.keys, self.depth = np.array(ids, np.int64), np.array(keys, np.int64), depth
        data = b"\n".join(raws) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        self.data = data
        self.starts, self.ends = word_spans(raw)
        self.words = word_hashes(raw, self.starts, self.ends)
        bounds = np.cumsum([len(r) + 1 for r in raws])
        self.first = np.concatenate([[0], np.searchsorted(self.starts, bounds)])  # each document's first word

    def windows(self, gram):
        """Minimiser of each window start (0 where no window starts), and the hash of the run of words at each place."""
        grams = gram_hashes(self.words, gram)
        low = _slide(grams, self.depth - gram + 1, np.minimum)
        doc = self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.first))
        low[doc[: len(low)] != doc[self.depth - 1 :][: len(low)]] = 0
        return low, grams

    def anchors(self, gram):
        """Documents and hashes of the places that are the minimiser of a window over them, each place once."""
        low, grams = self.windows(gram)
        if not len(low):
            return self.doc[:0], low
        edge = np.zeros(self.depth - gram, np.uint64)
        at = np.flatnonzero((_slide(np.concatenate([edge, low, edge]), self.depth - gram + 1, np.maximum) == grams) & (grams > 0))
        return self.doc[at], grams[at]


def _chunks(batches, depth):
    ids, keys, raws, extra, size = [], [], [], [], 0
    for batch in batches:
        rest = [c.to_pylist() for c in batch.columns[3:]]
        for i, (doc, key, raw) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True)):
            ids.append(doc)
            keys.append(key)
            raws.append(raw)
            extra.append([c[i] for c in rest])
            size += len(raw)
            if size >= CHUNK_BYTES:
                yield _Chunk(ids, keys, raws, depth), extra
                ids, keys, raws, extra, size = [], [], [], [], 0
    if ids:
        yield _Chunk(ids, keys, raws, depth), extra


def _rows(rows):
    for i in range(0, len(rows), 2000):
        cols = list(zip(*rows[i : i + 2000], strict=True))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)


def _per_document(chunk: _Chunk, docs: np.ndarray, values: np.ndarray, rows: list) -> None:
    """A FOUND row for each document with its values; docs rises."""
    cuts = np.flatnonzero(np.diff(docs)) + 1
    for own, part in zip(np.split(docs, cuts), np.split(values, cuts), strict=True):
        if len(own):
            i = own[0]
            rows.append((_spread(chunk.ids[i : i + 1]), FOUND, int(chunk.ids[i]), int(chunk.keys[i]), part.tobytes()))


_ENTRY = np.dtype([("value", "<u8"), ("id", "<i8"), ("key", "<i8")])


def _survey(buckets: int, depth: int, gram: int):
    def run(batches):
        for chunk, _ in _chunks(batches, depth):
            rows: list = []
            doc, low = chunk.anchors(gram)
            if not len(low):
                continue
            order = np.argsort(low, kind="stable")
            low, doc = low[order], doc[order]
            same = low[1:] == low[:-1]
            twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            lead = np.concatenate([[True], ~same])
            known = np.flatnonzero(twice)
            by_doc = known[np.argsort(doc[known], kind="stable")]
            _per_document(chunk, doc[by_doc], low[by_doc], rows)
            out = np.zeros(int(lead.sum()), _ENTRY)
            out["value"], out["id"], out["key"] = low[lead], chunk.ids[doc[lead]], chunk.keys[doc[lead]]
            bucket = (out["value"] >> np.uint64(40)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            out, bucket = out[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)):
                part = out[edges[b] : edges[b + 1]]
                rows.append((int(b), BUCKET, None, None, b"".join(part[f].tobytes() for f in ("value", "id", "key"))))
            yield from _rows(rows)

    return run


def _entries(data: bytes):
    n = len(data) // 24
    return np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.int64, n, 8 * n), np.frombuffer(data, np.int64, n, 16 * n)


def _gathered(batches):
    """(route, list of data) of each bucket, rows being sorted by kind and route; FOUND rows as batches."""
    route, held = None, []
    for batch in batches:
        kinds = batch.column(1).to_numpy()
        if kinds[0] == FOUND:
            yield None, batch
            continue
        cut = int(np.searchsorted(kinds, FOUND))
        for r, data in zip(batch.column(0)[:cut].to_pylist(), batch.column(4)[:cut].to_pylist(), strict=True):
            if r != route and held:
                yield route, held
                held = []
            route = r
            held.append(data)
        if cut < len(kinds):
            yield None, batch.slice(cut)
    if held:
        yield route, held


def _surviving(batches):
    for route, held in _gathered(batches):
        if route is None:
            yield held
            continue
        value, ids, keys = (np.concatenate(c) for c in zip(*map(_entries, held), strict=True))
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        keep = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        yield from _rows(_by_document(ids[keep], keys[keep], value[keep]))


def _spread(ids: np.ndarray) -> int:
    """A route for what belongs to a document."""
    return int(mix64(ids.view(np.uint64))[0] >> np.uint64(1))


def _by_document(ids, keys, values):
    order = np.lexsort((keys, ids))
    ids, keys, values = ids[order], keys[order], values[order]
    cuts = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1
    return [(_spread(i[:1]), FOUND, int(i[0]), int(k[0]), v.tobytes()) for i, k, v in zip(np.split(ids, cuts), np.split(keys, cuts), np.split(values, cuts), strict=True) if len(i)]


def _suffixes(buckets: int, salts: int, depth: int, gram: int):
    import zstandard

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for chunk, extra in _chunks(batches, depth):
            rows: list = []
            low, _ = chunk.windows(gram)
            at = np.flatnonzero(low)
            doc, low = chunk.doc[at], low[at]
            wanted = [np.unique(np.concatenate([np.frombuffer(d, np.uint64) for d in e[0]])) for e in extra]
            edges = np.searchsorted(doc, np.arange(len(extra) + 1))
            live = np.concatenate([np.isin(low[edges[i] : edges[i + 1]], w, kind="sort") for i, w in enumerate(wanted)] or [np.zeros(0, bool)])
            at, doc, low = at[live], doc[live], low[live]
            if not len(at):
                continue
            place = at - chunk.first[doc]
            ends = np.repeat(chunk.first[1:], np.diff(chunk.first))
            late = later_leaves(chunk.words, ends, at, chunk.ids[doc], place, depth, GROUP)
            _per_document(chunk, doc[late], place[late], rows)
            at, doc, low, place = at[~late], doc[~late], low[~late], place[~late]
            if len(at):
                # runs of consecutive windows with one minimiser
                fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])])
                head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                fresh |= (np.arange(len(at)) - head) % RUN == 0
                lead = np.flatnonzero(fresh)
                count = np.diff(np.concatenate([lead, [len(at)]]))
                bucket = (low[lead] >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                begin, end = chunk.starts[at[lead]], chunk.ends[at[lead] + count + depth - 2]
                salt = int(mix64(chunk.ids[:1].view(np.uint64) ^ chunk.keys[:1].view(np.uint64))[0] % np.uint64(salts))
                for b in np.flatnonzero(np.diff(cuts)):
                    own = order[cuts[b] : cuts[b + 1]]
                    texts = b"\n".join(b" ".join(chunk.data[begin[i] : end[i]].split()) for i in own)
                    heads = np.stack([chunk.ids[doc[lead[own]]], chunk.keys[doc[lead[own]]], place[lead[own]], count[own]])
                    rows.append((int(b) * salts + salt, BUCKET, None, None, _packed(packer, heads, texts)))
            yield from _rows(rows)

    return run


def _packed(packer, heads: np.ndarray, texts: bytes) -> bytes:
    """Runs of suffixes: ids, keys, places and counts, and the runs' words, a line each."""
    return heads.shape[1].to_bytes(8, "little") + packer.compress(heads.astype(np.int64).tobytes() + texts)


def _repeats(depth: int, salts: int):
    """Late suffixes of each bucket. With salts, of each salted part of it; runs that hold a part's first suffix go on to the bucket."""
    import zstandard

    def run(batches):
        opener, packer = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for route, held in _gathered(batches):
            if route is None:
                yield held
                continue
            heads, texts = [], []
            for data in held:
                n, data = int.from_bytes(data[:8], "little"), opener.decompress(data[8:])
                heads.append(np.frombuffer(data, np.int64, 4 * n).reshape(4, n))
                texts.append(data[32 * n :])
            heads, text = np.concatenate(heads, axis=1), b"\n".join(texts)
            ids, keys, place, count = heads
            begin, end = word_spans(raw := np.frombuffer(text, np.uint8))
            words = word_hashes(raw, begin, end)
            sizes = count + depth - 1
            first = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(ids)), count)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            late = later_leaves(words, np.repeat(first + sizes, sizes), first[owner] + step, ids[owner], place[owner] + step, depth, GROUP)
            if salts:
                on = np.unique(owner[~late])
                lines = b"\n".join(text[begin[first[i]] : end[first[i] + sizes[i] - 1]] for i in on)
                yield from _rows([(route // salts, BUCKET, None, None, _packed(packer, heads[:, on], lines))])
            owner, step = owner[late], step[late]
            yield from _rows(_by_document(ids[owner], keys[owner], place[owner] + step))

    return run


def _exchange(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "route").sortWithinPartitions("kind", "route")


def repeated_windows(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """doc_id, text_key, data (starts of repeated windows, several rows per document) from doc_id, text_key, text."""
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = buckets or 4 * n
    survey = _exchange(docs.mapInArrow(_survey(buckets, depth, gram), ROUTED), n).mapInArrow(_surviving, ROUTED)
    marks = materialise(survey.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "data"), "minimisers")
    release_shuffles(spark)
    marks = marks.groupBy("m_id", "m_key").agg(F.collect_list("data").alias("marks")).hint("shuffle_hash")
    marked = docs.join(marks, (F.col("doc_id") == F.col("m_id")) & (F.col("text_key") == F.col("m_key"))).select("doc_id", "text_key", "text", "marks")
    salts = max(4, round(n**0.5))
    parts = _exchange(marked.mapInArrow(_suffixes(buckets, salts, depth, gram), ROUTED), n).mapInArrow(_repeats(depth, salts), ROUTED)
    late = _exchange(parts, n).mapInArrow(_repeats(depth, 0), ROUTED)
    late = materialise(late.select("doc_id", "text_key", "data"), "repeats")
    release_shuffles(spark)
    return late


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (null ids last), text_key and text; the key tells rows with one id and different texts apart."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def spans_of(starts: np.ndarray, depth: int) -> np.ndarray:
    """Merged [begin, end) word spans of repeated windows: the maximal repeats' copies in one document."""
    starts = np.unique(starts)
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > depth) + 1
    return np.array([(p[0], p[-1] + depth) for p in np.split(starts, cut)])


def _removed(depth: int, keep_text: bool):
    def run(batches):
        for batch in batches:
            out = []
            for doc, raw, marks in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = raw.split()
                spans = spans_of(np.concatenate([np.frombuffer(m, np.int64) for m in marks]), depth) if marks else ()
                kept, at = [], 0
                for a, b in spans:
                    kept += words[at:a]
                    at = b
                kept = b" ".join(kept + words[at:]) if len(spans) else b" ".join(words)
                n = sum(int(b) - int(a) for a, b in spans)
                out.append((None if doc == _LAST_ID else doc, len(words), n, hashlib.sha256(kept).hexdigest(), [{"begin": int(a), "end": int(b)} for a, b in spans], kept.decode() if keep_text else None))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, keep_text: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, spans (removed word spans), kept_text.

    Null and empty texts have no words. Documents under `depth` words keep all. Rows with one id are at one
    place in the order: neither repeats the other at an equal start, and repeated rows give equal results. Null
    ids come last and share one place. Texts of any length are read whole. Other columns are ignored; an empty
    table gives an empty table.
    """
    rows = keyed(docs, id_col, text_col)
    late = repeated_windows(rows, depth, gram).select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key"), "data")
    late = late.groupBy("m_id", "m_key").agg(F.collect_list("data").alias("marks")).hint("shuffle_hash")
    joined = rows.join(late, (F.col("doc_id") == F.col("m_id")) & (F.col("text_key") == F.col("m_key")), "left").select("doc_id", "text", "marks")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept_text string"
    return joined.mapInArrow(_removed(depth, keep_text), schema)


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, unnest(generate_series(1, len(words) - 19)) AS s, words FROM d WHERE len(words) >= 20),
h AS (SELECT doc_id, s, sha256(array_to_string(words[s:s + 19], ' ')) AS h FROM w),
late AS (SELECT doc_id, s FROM h QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1),
gone AS (SELECT doc_id, list_distinct(flatten(list(generate_series(s, s + 19)))) AS gone FROM late GROUP BY doc_id),
e AS (SELECT doc_id, i, words[i] AS word, list_contains(gone, i) AS dropped FROM (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM d) LEFT JOIN gone USING (doc_id)),
k AS (SELECT doc_id, count(*) FILTER (dropped) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT coalesce(dropped, false)), '') AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def op1_substring_dedup(spark, sf_dir):
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
