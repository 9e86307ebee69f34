"""Near-duplicate linking with HyperMinHash sketches.

A document's set is its distinct word shingles. One hash per shingle picks one of REGISTERS buckets and the least
rest in each bucket is kept as a 16-bit register: leading-zero count and MANTISSA bits. Empty registers copy
the first non-empty one in an order of their own, so that short sets fill all bands. ROWS registers make a band; sets of one
Jaccard similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS (1 - 5e-11 at 0.85 for 32 bands of 4).

Documents with equal sets are one node. In each band bucket the least node is the pivot: its pairs with the bucket's
other nodes pass a size test, then the collision-corrected Jaccard estimate of the registers (five deviations below the
threshold), then the exact comparison of full sets. Links feed the components. Buckets whose other nodes then lie in one
component are done; the rest are compared block against block of at most about BLOCK nodes, each pair in the first band it shares. Finer
sketches (FINE registers of 4 bits) part a pair of blocks into chains of nodes of different components whose size and estimate allow
a link; the whole sets then meet in those parts, and links that join components of a part are made there, so a part gives fewer links than
it has rows. A tight group of m near copies costs about m comparisons. Of a bucket's m nodes in several components
each travels m / BLOCK times, and pairs are compared in memory alone: no bucket is gathered in a task, none is cut short.

A link is lost where its sets share no band, or an estimate is more than five deviations too low (3e-7 each, one in
five million by the normal law).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, gram_hashes, materialise, mix64, partitions, release_shuffles, row_id, text_bytes, text_key, without, word_hashes, word_spans
from .graph import components

REGISTERS, ROWS, MANTISSA = 128, 4, 10
BANDS = REGISTERS // ROWS
FINE = 512  # registers of the finer sketch of nodes that share a band, of 4 bits each
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
# Expected share of registers of different sets that agree by chance: 0.1699 * 2**(p - r) of 2**p (published constant).
COLLISIONS = 0.169919487159739 * 2.0 ** (7 - MANTISSA) / REGISTERS

_ORDERS = np.argsort(mix64(np.arange(REGISTERS * REGISTERS, dtype=np.uint64) + np.uint64(99)).reshape(REGISTERS, REGISTERS), axis=1)
_FINE_ORDERS = np.argsort(mix64(np.arange(FINE * FINE, dtype=np.uint64) + np.uint64(77)).reshape(FINE, FINE), axis=1).astype(np.int16)
_FINE_SHIFT = np.uint64(64 - 9)
_FINE_BOUNDS = np.arange(FINE, dtype=np.uint64) << _FINE_SHIFT
_SHIFT = np.uint64(64 - 7)
_BOUNDS = np.arange(REGISTERS, dtype=np.uint64) << _SHIFT


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z lower-cased; a shorter text is one shingle."""
    raw = np.frombuffer(text.lower(), np.uint8)
    words = word_hashes(raw, *word_spans(raw))
    if len(words) == 0:
        return words
    if len(words) < width:
        return mix64(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(gram_hashes(words, width))


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted, non-empty set."""
    at = np.searchsorted(shingles, _BOUNDS)
    inside = np.minimum(at, len(shingles) - 1)
    filled = (at < len(shingles)) & (shingles[inside] >> _SHIFT == np.arange(REGISTERS, dtype=np.uint64))
    rest = shingles[inside] & ((np.uint64(1) << _SHIFT) - np.uint64(1)) | np.uint64(1)
    # frexp is exact enough for the bit length once the value fits a double's 53 bits; the low bits can only round it up
    length = np.frexp((rest >> np.uint64(5)).astype(np.float64) + 0.5)[1] + 5
    length = np.maximum(length, 1).astype(np.uint64)
    lead = (np.uint64(57) - np.minimum(length, np.uint64(57))) & np.uint64(63)
    mantissa = (rest << (lead + np.uint64(7)) >> np.uint64(64 - MANTISSA - 1)) & np.uint64((1 << MANTISSA) - 1)
    made = (lead << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        first = filled[_ORDERS[empty]].argmax(1)
        made[empty] = made[_ORDERS[empty, first]]
    return made


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """Four mixed bits of each of FINE buckets' least hash; empty buckets copy as in `registers`."""
    at = np.searchsorted(shingles, _FINE_BOUNDS)
    inside = np.minimum(at, len(shingles) - 1)
    filled = (at < len(shingles)) & (shingles[inside] >> _FINE_SHIFT == np.arange(FINE, dtype=np.uint64))
    made = (mix64(shingles[inside]) & np.uint64(15)).astype(np.uint8)
    if not filled.all():
        empty = np.flatnonzero(~filled)
        made[empty] = made[_FINE_ORDERS[empty, filled[_FINE_ORDERS[empty]].argmax(1)]]
    return made


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.astype(np.uint64).reshape(BANDS, ROWS)
    packed = rows[:, 0] | rows[:, 1] << np.uint64(16) | rows[:, 2] << np.uint64(32) | rows[:, 3] << np.uint64(48)
    return mix64(mix64(packed) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _sketches(width: int):
    def run(batches):
        for batch in batches:
            size, sig, sketch = [], [], []
            for text in text_bytes(batch.column(1)):
                found = shingle_set(text, width)
                size.append(len(found))
                sig.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                sketch.append(registers(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "text_key", "n", "sig", "sketch"])

    return run


def _banded(batches):
    for batch in batches:
        keys = [band_keys(np.frombuffer(s, np.uint16)).view(np.int64) for s in batch.column(2).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(keys)), BANDS))
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column(0).take(at), batch.column(1).take(at)], names=["band", "node", "n"])


def _estimated(percent: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n = np.maximum(batch.column(4).to_numpy(), 1)
            share = (a == b).mean(1)
            keep = pa.array(_passes(share, n, percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], names=["a", "b", "estimate"]).filter(keep)

    return run


def _passes(share: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Whether the collision-corrected estimate of the Jaccard similarity is within five deviations of the threshold; n: smaller set's size."""
    s = percent / 100
    slack = 5 * np.sqrt(s * (1 - s) / np.maximum(1, np.minimum(REGISTERS, n) / 2))
    return np.clip((share - COLLISIONS) / (1 - COLLISIONS), 0, 1) >= s - slack - 1e-9


def _blocked(live: DataFrame) -> DataFrame:
    """`live` with block, and a row for each pair of blocks (lo <= hi) the row's block takes part in. A block has BLOCK rows and BLOCK_SHINGLES
    shingles or so (a longer set makes a larger one)."""
    blocks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)))
    sizes = live.groupBy("band").agg(blocks.cast("int").alias("__k"))
    rows = live.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("node"), F.col("__k")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    return rows.withColumn("lo", F.least("block", "__other")).withColumn("hi", F.greatest("block", "__other")).drop("__k", "__other")


def _sets(width: int):
    """node, its finer sketch, its whole set."""

    def run(batches):
        for batch in batches:
            found = [shingle_set(t, width) for t in text_bytes(batch.column(1))]
            fine = [fine_sketch(f) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(m[::2] | m[1::2] << 4).tobytes() for m in fine], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], names=["node", "fine", "shingles"])

    return run


def _fine_passes(share: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """As _passes for the finer sketch, where different sets' registers agree by chance once in 16."""
    s = percent / 100
    slack = 5 * np.sqrt(s * (1 - s) / np.maximum(1, np.minimum(FINE, n))) * 16 / 15
    return (share - 1 / 16) * 16 / 15 >= s - slack - 1e-9


PART = "band long, lo int, hi int, part int, block int, node binary, n long, comp binary, sketch binary, fine binary"
_NAMES = [c.split()[0] for c in PART.split(", ")]


class _Part:
    """The rows of one pair of blocks (or of one part of it), smallest set first, and which pairs of them are to be compared."""

    def __init__(self, rows: list[tuple], percent: int):
        self.rows, self.percent = sorted(rows, key=lambda r: (r[6], r[5])), percent
        self.band, self.lo, self.hi = rows[0][:3]
        self.n, self.block = np.array([r[6] for r in self.rows], np.int64), np.array([r[4] for r in self.rows])
        self.comp = np.unique([r[7] for r in self.rows], return_inverse=True)[1]
        self.sketch = np.frombuffer(b"".join(r[8] for r in self.rows), np.uint16).reshape(-1, BANDS, ROWS)
        packed = np.frombuffer(b"".join(r[9] for r in self.rows), np.uint8).reshape(len(rows), -1)
        self.fine = np.concatenate([packed & 15, packed >> 4], axis=1)
        self.at = int(np.argmax(band_keys(self.sketch[0].ravel()).view(np.int64) == self.band))

    def partners(self, i: int) -> np.ndarray:
        """Later rows of other components whose size and finer estimate allow a link with row i, and that share no earlier band with it:
        such a pair is compared there, or was when its pivot was."""
        j = np.arange(i + 1, np.searchsorted(self.n, 100 * self.n[i] // self.percent, "right"))
        j = j[(self.comp[j] != self.comp[i]) & ((self.block[j] != self.block[i]) | (self.lo == self.hi))]
        if len(j):
            j = j[_fine_passes((self.fine[j] == self.fine[i]).mean(1), self.n[i], self.percent)]
        if len(j) and self.at:
            j = j[~(self.sketch[j, : self.at] == self.sketch[i, : self.at]).all(2).any(1)]
        return j


class _Union:
    def __init__(self, size: int):
        self.root = list(range(size))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = x = self.root[self.root[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.root[max(x, y)] = min(x, y)
        return x != y


def _groups(batches, keys: int):
    """Lists of the rows that agree in the first `keys` columns, of batches sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _parted(percent: int):
    """The rows that have a partner within their pair of blocks, with the least row their chain of partners leads to as part."""

    def run(batches):
        for rows in _groups(batches, 3):
            part = _Part(rows, percent)
            union = _Union(len(rows))
            for i in range(len(rows) - 1):
                for j in part.partners(i).tolist():
                    union.join(i, j)
            roots = [union.find(i) for i in range(len(rows))]
            shared = np.bincount(roots, minlength=len(rows)) > 1
            kept = [(*r[:3], root, *r[4:]) for r, root in zip(part.rows, roots, strict=True) if shared[root]]
            for at in range(0, len(kept), 1000):
                yield pa.RecordBatch.from_pydict({name: [r[i] for r in kept[at : at + 1000]] for i, name in enumerate(_NAMES)}, schema=_part_schema())

    return run


def _part_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PART.split(", ")])


def _reached(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _joined(percent: int):
    """Links, by full sets, that join components of a part: one fewer than it has rows at most."""

    def run(batches):
        out: list[tuple] = []
        for rows in _groups(batches, 4):
            part = _Part(rows, percent)
            sets = [np.frombuffer(r[10], np.uint64) for r in part.rows]
            union = _Union(len(rows))
            for i in range(len(rows) - 1):
                for j in part.partners(i).tolist():
                    a, b = int(part.comp[i]), int(part.comp[j])
                    if union.find(a) != union.find(b) and _reached(sets[i], sets[j], percent):
                        union.join(a, b)
                        out.append((part.rows[i][5], part.rows[j][5]))
            if len(out) > 10_000:
                yield _pairs_batch(out)
                out = []
        yield _pairs_batch(out)

    return run


def _pairs_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.binary()), pa.array([p[1] for p in out], pa.binary())], names=["a", "b"])


def _verified(width: int, percent: int):
    def run(batches):
        for batch in batches:
            keep, cache = [], {}
            for a, ta, tb in zip(batch.column(0).to_pylist(), text_bytes(batch.column(2)), text_bytes(batch.column(3)), strict=True):
                if a not in cache:
                    cache = {a: shingle_set(ta, width)}
                keep.append(_reached(cache[a], shingle_set(tb, width), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after joining the components that `links` (a, b) connect."""
    a, b = labels.select(F.col("node").alias("a"), F.col("comp").alias("u")), labels.select(F.col("node").alias("b"), F.col("comp").alias("v"))
    roots = components(links.join(a, "a").join(b, "b").select("u", "v"))
    return materialise(labels.join(roots, F.col("comp") == F.col("u"), "left").select("node", F.coalesce("v", "comp").alias("comp")), "labels")


def _live(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """band, node, n, comp of buckets whose untaken nodes lie in several components."""
    rows = entries.join(labels, "node")
    mixed = rows.groupBy("band").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi")).where("__lo <> __hi").select("band")
    return rows.join(mixed, "band", "left_semi").select("band", "node", "n", "comp")


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Texts meet the pairs at b last, sorted by a."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return materialise(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(width, percent), "a binary, b binary"), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Sets are linked if 100 * intersection >= percent * union; components are closed over links, named by their
    smallest id. Null, empty and white texts have empty sets and are linked with nothing. Rows that repeat a
    kept id are kept too. Null ids come last and stay null. Texts are read whole; other columns are ignored; an
    empty table gives an empty table. Words are compared by 64-bit hashes.
    """
    found = _grouped(docs, width, percent, id_col, text_col)
    null = lambda c: F.when(F.col(c) != LAST_ID, F.col(c)).alias(c)
    return found.select(null("doc_id"), F.col("n").alias("n_shingles"), null("component_id"), (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id as by row_id, text_key, n, component_id and stays (whether id and text are those of the component's one row
    that stays, or the set is empty) for every row of `docs`."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_id(id_col).alias("doc_id"), text.alias("text"), text_key(text_col).alias("text_key"))
    sketched = materialise(rows.mapInArrow(_sketches(width), "doc_id long, text_key long, n long, sig binary, sketch binary"), "sketches")
    # a node's name sorts by its smallest id: 8 bytes of the id, offset to be unsigned, and the set's 16-byte digest
    name = F.concat(F.unhex(F.concat(F.lpad(F.hex(F.shiftrightunsigned("id", 32).bitwiseXOR(F.lit(1 << 31))), 8, "0"), F.lpad(F.hex(F.col("id").bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))), F.col("sig"))
    sets = sketched.where("n > 0").groupBy("sig").agg(F.min(F.struct("doc_id", "text_key", "n", "sketch")).alias("r"))
    sets = sets.select("sig", F.col("r.doc_id").alias("id"), "r.text_key", "r.n", "r.sketch").withColumn("node", name)
    nodes = materialise(sets.select("node", "n", "sketch", "id", "text_key", "sig"), "nodes")
    entries = nodes.select("node", "n", "sketch").mapInArrow(_banded, "band long, node binary, n long")
    shared = entries.groupBy("band").agg(F.count("*").alias("__m")).where("__m > 1").select("band")
    entries = materialise(entries.join(shared, "band"), "entries")
    release_shuffles(spark)
    labels = materialise(entries.select("node").distinct().withColumn("comp", F.col("node")), "labels")
    near = labels.join(nodes, "node").select("node", F.col("id").alias("__id"), F.col("text_key").alias("__key")).hint("shuffle_hash")
    texts = rows.join(near, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key"))).select("node", "text").dropDuplicates(["node"])
    texts = materialise(texts, "texts")
    release_shuffles(spark)
    sketches = nodes.select("node", "sketch")
    # first every bucket's least node against its others: one turn links most of a tight group, however large
    taken = materialise(entries.groupBy("band").agg(F.min(F.struct("node", "n")).alias("p")).select("band", F.col("p.node").alias("a"), F.col("p.n").alias("na")), "pivots")
    pairs = entries.join(taken, "band").where((F.col("node") != F.col("a")) & (100 * F.least("n", "na") >= percent * F.greatest("n", "na")))
    pairs = pairs.select("a", F.col("node").alias("b"), F.least("n", "na").alias("n")).distinct()
    a, b = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
    pairs = materialise(pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb", "n").mapInArrow(_estimated(percent), "a binary, b binary, estimate double"), "pairs")
    labels = _relabel(labels, _links(pairs, texts, width, percent))
    entries = materialise(entries.join(taken.select("band", F.col("a").alias("node")), ["band", "node"], "left_anti"), "entries")
    release_shuffles(spark)
    # then what is left in a bucket between different components, block against block
    live = materialise(_live(entries, labels), "live")
    sets = materialise(texts.join(live.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_sets(width), "node binary, fine binary, shingles binary"), "sets")
    known = sets.select("node", "fine").join(sketches, "node")
    blocks = _blocked(live).withColumn("part", F.lit(0)).join(known, "node").select(*_NAMES)
    parts = blocks.repartition(partitions(spark), "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").mapInArrow(_parted(percent), PART)
    parts = materialise(parts, "parts").join(sets.select("node", "shingles"), "node").select(*_NAMES, "shingles")
    parts = parts.repartition(partitions(spark), "band", "lo", "hi", "part").sortWithinPartitions("band", "lo", "hi", "part")
    labels = _relabel(labels, materialise(parts.mapInArrow(_joined(percent), "a binary, b binary"), "joins"))
    release_shuffles(spark)
    root = nodes.join(labels, "node", "left").select("sig", F.coalesce("comp", "node").alias("comp"), "node", "id", F.col("text_key").alias("key"))
    high = F.conv(F.hex(F.substring("comp", 1, 4)), 16, 10).cast("long").bitwiseXOR(F.lit(1 << 31))
    low = F.conv(F.hex(F.substring("comp", 5, 4)), 16, 10).cast("long")
    root = root.select("sig", F.shiftleft(high, 32).bitwiseOR(low).alias("component_id"), (F.col("node") == F.col("comp")).alias("first"), "id", "key")
    found = sketched.select("doc_id", "text_key", "n", "sig").join(root, "sig", "left")
    stays = F.col("sig").isNull() | (F.col("first") & (F.col("doc_id") == F.col("id")) & (F.col("text_key") == F.col("key")))
    return found.select("doc_id", "text_key", "n", F.coalesce("component_id", "doc_id").alias("component_id"), stays.alias("stays"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` without the rows that another document of their component stands for; all columns stay. Rows are told apart
    by id and text, so that null and repeated ids don't matter; of rows that repeat both, empty ones too, one stays."""
    gone = _grouped(docs, width, percent, id_col, text_col).where(~F.col("stays"))
    return without(docs, gone, id_col, text_col)


OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [md5(array_to_string(w, ' '))]
        ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM d),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, s FROM s),
c AS (SELECT min(doc_id) AS c, n_shingles, list_sort(s) AS s FROM n WHERE n_shingles > 0 GROUP BY 2, 3),
m AS (SELECT n.doc_id, c.c FROM n JOIN c ON n.n_shingles = c.n_shingles AND list_sort(n.s) = c.s),
e AS (SELECT c, n_shingles, unnest(s) AS h FROM c),
-- any common set of the size the link needs reaches into the least 16 percent of the smaller set's shingles
p AS (SELECT c, h FROM e QUALIFY row_number() OVER (PARTITION BY c ORDER BY h) <= n_shingles - ceil(0.85 * n_shingles) + 1),
k AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.h = b.h AND a.c < b.c),
l AS (SELECT a, b FROM k JOIN c x ON x.c = a JOIN c y ON y.c = b
      WHERE 100 * least(x.n_shingles, y.n_shingles) >= 85 * greatest(x.n_shingles, y.n_shingles)
        AND 185 * len(list_intersect(x.s, y.s)) >= 85 * (x.n_shingles + y.n_shingles)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT c, c FROM c UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
f AS (SELECT a AS c, min(b) AS root FROM r GROUP BY a)
SELECT doc_id, n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM n LEFT JOIN m USING (doc_id) LEFT JOIN f USING (c)
"""


def op10_minhash(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
