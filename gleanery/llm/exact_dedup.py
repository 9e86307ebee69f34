"""Exact deduplication through a cuckoo-filter index of live digests.

Every text is normalised by deleting ASCII white space and reduced to its SHA-256. The digests are
spread over shards; each shard keeps a `CuckooIndex`: short fingerprints in a cuckoo filter answer
"surely new" at once, and a fingerprint hit is verified against the full digest and length stored in
the same bucket slot. Entries can be deleted, and a filter that overflows is rebuilt at twice its size
from the stored keys. Copies are folded inside each task before they travel, so that a group holding a
third of all rows reaches its shard as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, partitions, row_id, text_bytes, text_key, without

WHITE_SPACE = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """A cuckoo filter whose slots point at stored keys and payloads.

    `find` is exact: a fingerprint hit counts only if the slot's stored key is equal. `insert` of a key
    already present replaces its payload. `delete` frees the slot. When an insertion can't find a slot in
    MAX_KICKS moves the filter doubles and is refilled from the stored keys.
    """

    def __init__(self, capacity: int = 64):
        self.keys: list[bytes | None] = []
        self.values: list = []
        self.free: list[int] = []
        self.live = 0
        self.resizes = -1
        self._allot(capacity)

    def _allot(self, capacity: int) -> None:
        self.mask = (1 << max(2, (max(1, capacity) * 5 // 4 // SLOTS).bit_length())) - 1
        self.prints = [0] * ((self.mask + 1) * SLOTS)
        self.slots = [-1] * ((self.mask + 1) * SLOTS)
        self.resizes += 1

    def _place(self, key: bytes) -> tuple[int, int, int]:
        """Fingerprint and both buckets; the digest's own bits serve as hashes."""
        print_ = int.from_bytes(key[:2], "big") or 1
        first = int.from_bytes(key[2:10], "big") & self.mask
        return print_, first, self._other(first, print_)

    def _other(self, bucket: int, print_: int) -> int:
        return (bucket ^ (print_ * 0x5BD1E995)) & self.mask

    def _slot(self, key: bytes) -> int:
        print_, first, second = self._place(key)
        for bucket in (first, second) if first != second else (first,):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.prints[at] == print_ and self.slots[at] >= 0 and self.keys[self.slots[at]] == key:
                    return at
        return -1

    def find(self, key: bytes):
        at = self._slot(key)
        return self.values[self.slots[at]] if at >= 0 else None

    def insert(self, key: bytes, value) -> None:
        at = self._slot(key)
        if at >= 0:
            self.values[self.slots[at]] = value
            return
        if self.free:
            entry = self.free.pop()
            self.keys[entry], self.values[entry] = key, value
        else:
            entry = len(self.keys)
            self.keys.append(key)
            self.values.append(value)
        self.live += 1
        if not self._put(key, entry):
            self._grow()

    def _put(self, key: bytes, entry: int) -> bool:
        print_, bucket, second = self._place(key)
        for kick in range(MAX_KICKS):
            for b in (bucket, second):
                for at in range(b * SLOTS, b * SLOTS + SLOTS):
                    if self.slots[at] < 0:
                        self.prints[at], self.slots[at] = print_, entry
                        return True
            at = second * SLOTS + (kick * 7 + print_) % SLOTS
            print_, self.prints[at] = self.prints[at], print_
            entry, self.slots[at] = self.slots[at], entry
            bucket = second
            second = self._other(bucket, print_)
        return False

    def _grow(self) -> None:
        """Rebuild from the stored keys; doubles until all of them fit."""
        capacity = (self.mask + 1) * SLOTS
        while True:
            self._allot(capacity := capacity * 2)
            if all(self._put(key, i) for i, key in enumerate(self.keys) if key is not None):
                return

    def delete(self, key: bytes) -> bool:
        at = self._slot(key)
        if at < 0:
            return False
        entry = self.slots[at]
        self.slots[at], self.prints[at] = -1, 0
        self.keys[entry] = self.values[entry] = None
        self.free.append(entry)
        self.live -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)


def normalised_digest(text: bytes) -> tuple[bytes, int]:
    import hashlib

    bare = text.translate(None, WHITE_SPACE)
    return hashlib.sha256(bare).digest(), len(bare)


def _digests(batches):
    for batch in batches:
        texts = text_bytes(batch.column(1))
        made = [normalised_digest(t) for t in texts]
        chars = pc.fill_null(pc.utf8_length(batch.column(1)), 0).cast(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([d for d, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64()), chars, batch.column(2)],
            names=["doc_id", "digest", "n_bytes", "n_chars", "text_key"],
        )


_GROUP = "shard int, digest binary, n_bytes long, best_chars long, keep_id long, keep_key long, group_size long"
_LAST = np.iinfo(np.int64).max


def _better(a: tuple, b: tuple) -> tuple:
    """The row that stays: more characters, then the smaller id, null ids last, then the smaller text key; sizes add up."""
    (chars, doc, text, n), (chars2, doc2, text2, n2) = a, b
    if (-chars2, doc2 is None, doc2 or 0, text2) < (-chars, doc is None, doc or 0, text):
        chars, doc, text = chars2, doc2, text2
    return chars, doc, text, n + n2


def _emit(index: CuckooIndex, shards: int):
    rows = list(index.items())
    for i in range(0, len(rows), 20_000):
        part = rows[i : i + 20_000]
        keys = [k for k, _ in part]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(k[:4], "big") % shards for k in keys], pa.int32()),
                pa.array([k[:32] for k in keys], pa.binary()),
                pa.array([int.from_bytes(k[32:], "big") for k in keys], pa.int64()),
                pa.array([v[0] for _, v in part], pa.int64()),
                pa.array([v[1] for _, v in part], pa.int64()),
                pa.array([v[2] for _, v in part], pa.int64()),
                pa.array([v[3] for _, v in part], pa.int64()),
            ],
            names=["shard", "digest", "n_bytes", "best_chars", "keep_id", "keep_key", "group_size"],
        )


def _fold(shards: int, flush: int | None):
    """Fold rows into a cuckoo index. Before the exchange it is flushed at `flush` entries; behind it, a new
    index starts with each shard, as rows arrive in order of shard."""

    def run(batches):
        index, shard = CuckooIndex(), None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            raw = len(cols) == 5
            for row in zip(*cols, strict=True):
                if raw:
                    doc, digest, n_bytes, chars, text = row
                    new = (chars, doc, text, 1)
                else:
                    at, digest, n_bytes, chars, doc, text, size = row
                    new = (chars, doc, text, size)
                    if at != shard:
                        yield from _emit(index, shards)
                        index, shard = CuckooIndex(), at
                key = digest + n_bytes.to_bytes(8, "big")
                old = index.find(key)
                index.insert(key, new if old is None else _better(old, new))
                if flush and index.live >= flush:
                    yield from _emit(index, shards)
                    index = CuckooIndex()
        yield from _emit(index, shards)

    return run


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting space, tab, LF, VT, FF and CR; null counts as empty, and all
    empty texts form one group. The row with most code points stays, then the smallest id; null ids come
    last. Rows that repeat the staying row's id are flagged as kept too. Other columns are ignored, whatever
    their names. An empty table gives an empty table. Length is no limit: only the digest leaves the scan.
    """
    return _grouped(docs, id_col, text_col, shards).drop("text_key", "stays")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shards: int | None = None) -> DataFrame:
    """exact_groups with text_key and stays: whether id and text are those of the group's one row that stays."""
    spark = docs.sparkSession
    shards = shards or partitions(spark) * 16
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_key(text_col).alias("text_key"))
    keys = materialise(rows.mapInArrow(_digests, "doc_id long, digest binary, n_bytes long, n_chars long, text_key long"), "digests")
    groups = (
        keys.mapInArrow(_fold(shards, 100_000), _GROUP)
        .repartition(partitions(spark), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_fold(shards, None), _GROUP)
        .select("digest", "n_bytes", "keep_id", "keep_key", "group_size")
    )
    return keys.join(groups, ["digest", "n_bytes"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "n_chars",
        "text_key",
        ((row_id("doc_id") == row_id("keep_id")) & (F.col("text_key") == F.col("keep_key"))).alias("stays"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows whose text another row stands for; all columns stay as they are. Rows are told apart by id
    and text, so that null and repeated ids don't matter; of rows that repeat both, one stays."""
    gone = _grouped(docs, id_col, text_col).where(~F.col("stays")).select(row_id("doc_id").alias("doc_id"), "text_key")
    return without(docs, gone, id_col, text_col)


OP8_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS n FROM documents),
     g AS (SELECT text_sha256, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""


def op8_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_chars")
