"""Helpers shared by the corpus operators: shared-folder tables, row batches, word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one of our own, on a local master alone (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gleanery-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _sweep() -> None:
    for spark, path in _CLEAN:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            return


atexit.register(_sweep)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: this cuts the lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _CLEAN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of stages whose output has been materialised."""
    for _ in range(2):  # the cleaner learns of dead plans by the collector's reports, a moment later
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * factor


LAST_ID = (1 << 63) - 1


def row_id(id_col: str) -> Column:
    """The id as a long that is never null: null ids come last."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))


def text_key(text_col: str) -> Column:
    """With the id, it names a row's text: ids may be null or repeat. Null is empty."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the rows whose id and text are in `gone` (doc_id as by row_id, text_key), and of the rows that repeat
    id and text one: the least by a hash of its other columns (maps aside). All columns stay."""
    rest = [F.col(c) for c, kind in docs.dtypes if c not in (id_col, text_col) and "map<" not in kind]
    rows = docs.select(F.struct("*").alias("__row"), row_id(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.xxhash64(F.lit(0), *rest).alias("__rest"))
    rows = rows.join(gone.select("doc_id", "text_key").distinct(), ["doc_id", "text_key"], "left_anti")
    return rows.groupBy("doc_id", "text_key").agg(F.min_by("__row", "__rest").alias("__row")).select("__row.*")


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a string column's values; null is empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


# --- words and their hashes -------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BLOCK = 1 << 19
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
            _inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _powers, _inverses


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than space, tab, LF, VT, FF and CR."""
    edge = np.diff(np.concatenate([[True], _SPACE[raw], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, alike wherever the word stands. Works in blocks of whole words."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    if len(starts) > 1 and len(raw) > _BLOCK:
        cuts = np.unique(np.concatenate([[0], np.searchsorted(starts, np.arange(_BLOCK, len(raw), _BLOCK)), [len(starts)]]))
        if len(cuts) > 2:
            parts = ((int(starts[a]), int(ends[a:b].max()), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            return np.concatenate([_hashes(raw[lo:hi], starts[own] - lo, ends[own] - lo) for lo, hi, own in parts])
    return _hashes(raw, starts, ends)


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _table(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], dtype=np.uint64)])
        value = (total[ends] - total[starts]) * inverse[starts]
        return mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive words, by a rolling polynomial over the word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=np.uint64)
        for i in range(k):
            out = out * np.uint64(0xA24BAED4963EE407) + words[i : i + n]
            if i % 4 == 3:
                out ^= out >> np.uint64(29)
        return mix64(out)
