"""Exact top-k search by inner product with a three-phase uniform threshold.

The dimensions are cut into NODES blocks. Each block is a node, whose list holds the local score (the partial inner
product) of every candidate, best first. For each block of queries:
1. the k first entries of each node's list are gathered and their totals resolved: the k-th best total is a sure lower
   bound t of the result's last score;
2. t is broadcast. A candidate whose local scores all stay below the uniform cutoff t / nodes sums up to less than t, so
   only entries at or above the cutoff are collected, and those candidates go on whose upper bound (collected local
   scores, and the cutoff for the others) reaches t;
3. only their totals are resolved, and the best k of each task, then of all tasks, are kept.
`search` also counts the totals it resolves. Integers in doubles are exact while local scores stay below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

K = 5
SCALE = 256
NODES = 2  # with more nodes the uniform cutoff is lower and more entries pass it
QUERY_BLOCK = 1 << 14  # ids broadcast at a time; 100 million vectors make 123 blocks of full scans
CHUNK = 1024  # queries and candidates multiplied at a time
PAIRS = 1 << 16  # totals resolved at a time
LOWEST = -float(1 << 62)

ENTRY = "query_id long, vec_id long, score long, resolved long"


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v array<long> with v = floor(scale * x), x as double. Rows null or with null or non-finite components are left out."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    return vectors.where(fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * F.lit(float(scale)))).alias("v"))


class _Batch:
    """Ids and matrix of the vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors

    def local(self, other: _Batch, nodes: int) -> list[np.ndarray]:
        """Each node's local scores of this batch's rows (queries) against those of `other`; -inf where the ids are one."""
        width = self.vectors.shape[1]
        same = self.ids[:, None] == other.ids[None, :]
        scores = []
        for c in np.array_split(np.arange(width), max(1, min(nodes, width))):
            score = self.vectors[:, c].astype(np.float64) @ other.vectors[:, c].astype(np.float64).T
            score[same] = -np.inf
            scores.append(score)
        return scores

    def chunks(self):
        for at in range(0, len(self.ids), CHUNK):
            yield at, _Batch(self.ids[at : at + CHUNK], self.vectors[at : at + CHUNK])


def _by_width(ids: np.ndarray, vectors: pa.Array) -> dict[int, _Batch]:
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, first = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    return {int(w): _Batch(ids[at := np.flatnonzero(lengths == w)], flat[first[at][:, None] + np.arange(w)]) for w in np.unique(lengths)}


def _totals(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of b, in integers."""
    parts = [np.einsum("pd,pd->p", a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class _Best:
    """Of entries (query, vec_id, order, total), each query's k first by order, then smaller id; an id counts by its first entry."""

    def __init__(self, k: int):
        self.k, self.held, self.size = k, [], 0

    def add(self, *entries: np.ndarray) -> None:
        self.held.append(entries)
        self.size += len(entries[0])
        if self.size > 1 << 20:
            self.entries()

    def entries(self) -> tuple[np.ndarray, ...]:
        if not self.size:
            return (np.zeros(0, np.int64),) * 4
        query, vec, order, total = (np.concatenate(c) for c in zip(*self.held, strict=True))
        by = np.lexsort((-order, vec, query))
        query, vec, order, total = query[by], vec[by], order[by], total[by]
        lead = np.concatenate([[True], (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])])
        query, vec, order, total = query[lead], vec[lead], order[lead], total[lead]
        by = np.lexsort((vec, -order, query))
        query = query[by]
        fresh = np.concatenate([[True], query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.maximum.accumulate(np.where(fresh, np.arange(len(query)), 0))
        by = by[place < self.k]
        out = (query[place < self.k], vec[by], order[by], total[by])
        self.held, self.size = [out], len(by)
        return out


def _rows(best: _Best, ids: np.ndarray | None = None, resolved: np.ndarray | None = None):
    query, vec, _, total = best.entries()
    more = np.flatnonzero(resolved) if resolved is not None else query[:0]
    lone, none = pa.nulls(len(more), pa.int64()), pa.nulls(len(query), pa.int64())
    columns = [(pa.array(query), pa.array(ids[more]) if len(more) else lone), (pa.array(vec), lone), (pa.array(total), lone), (none, pa.array(resolved[more]) if len(more) else lone)]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["query_id", "vec_id", "score", "resolved"])


def _gathered(shared, k: int, nodes: int):
    """Phase 1 over one task's rows: the k first entries of each node's list, with totals."""

    def run(batches):
        queries = shared.value
        lists = [_Best(k) for _ in range(nodes)]
        for batch in batches:
            for width, rows in _by_width(batch.column(0).to_numpy(), batch.column(1)).items():
                for _, mine in queries[width].chunks() if width in queries else ():
                    for _, part in rows.chunks():
                        for best, local in zip(lists, mine.local(part, nodes), strict=False):
                            take = min(k, local.shape[1])
                            j = np.argpartition(-local, take - 1, axis=1)[:, :take].ravel()
                            i = np.repeat(np.arange(len(mine.ids)), take)
                            real = np.isfinite(local[i, j])
                            i, j = i[real], j[real]
                            best.add(mine.ids[i], part.ids[j], local[i, j], _totals(mine.vectors, part.vectors, i, j))
        for best in lists:
            yield _rows(best)

    return run


def _resolved(shared, k: int, nodes: int):
    """Phases 2 and 3 over one task's rows: the k best totals, and (vec_id null) how many each query resolved."""

    def run(batches):
        queries, ids, bounds = shared.value
        best, count = _Best(k), np.zeros(len(ids), np.int64)
        for batch in batches:
            for width, rows in _by_width(batch.column(0).to_numpy(), batch.column(1)).items():
                for _, mine in queries[width].chunks() if width in queries else ():
                    own = np.searchsorted(ids, mine.ids)
                    bound = bounds[own][:, None]
                    for _, part in rows.chunks():
                        local = mine.local(part, nodes)
                        cutoff = np.floor(bound / len(local))
                        collected = np.any([x >= cutoff for x in local], axis=0)
                        upper = np.sum([np.maximum(x, cutoff) for x in local], axis=0)
                        i, j = np.nonzero(collected & (upper >= bound) & np.isfinite(local[0]))
                        total = _totals(mine.vectors, part.vectors, i, j)
                        np.add.at(count, own[i], 1)
                        keep = total >= bound[i, 0]
                        best.add(mine.ids[i[keep]], part.ids[j[keep]], total[keep], total[keep])
        yield _rows(best, ids, count)

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; the score of two ids is the best over their vectors."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, every: int = 50, k: int = K, nodes: int = NODES, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, block: int = QUERY_BLOCK) -> tuple[DataFrame, DataFrame]:
    """The result of `top_k`, and query_id, resolved: how many totals phase 3 resolved for it."""
    spark = vectors.sparkSession
    rows = materialise(scaled(vectors, id_col, vector_col, scale).dropDuplicates(["vec_id", "v"]), "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    n = max(1, -(-queries.count() // block))
    queries = queries.withColumn("__block", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
    found = spark.createDataFrame([], ENTRY)
    for at in range(n):
        # a block of the stated query set has `block` vectors, give or take the hash's spread and an id's own vectors
        mine = queries.where(F.col("__block") == at).select("vec_id", "v").toArrow()
        if not mine.num_rows:
            continue
        own = _by_width(mine["vec_id"].to_numpy(), mine["v"].combine_chunks())
        ids = np.unique(mine["vec_id"].to_numpy())
        lists = rows.mapInArrow(_gathered(spark.sparkContext.broadcast(own), k, nodes), ENTRY)
        last = _top(lists, k).where(F.col("rank") == k).select("query_id", "score").toArrow()  # a row per query of the block
        bounds = np.full(len(ids), LOWEST)
        bounds[np.searchsorted(ids, last["query_id"].to_numpy())] = last["score"].to_numpy()
        shared = spark.sparkContext.broadcast((own, ids, bounds))
        found = found.unionByName(materialise(rows.mapInArrow(_resolved(shared, k, nodes), ENTRY), "topk"))
    hits = _top(found.where(F.col("vec_id").isNotNull()), k).select("query_id", "rank", "vec_id", "score")
    return hits, found.where(F.col("vec_id").isNull()).groupBy("query_id").agg(F.sum("resolved").alias("resolved"))


def top_k(vectors: DataFrame, every: int = 50, k: int = K, nodes: int = NODES, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k best other rows.

    Ties go to the smaller id; with fewer candidates than k all are returned. Vectors that are null or hold null
    or non-finite components take no part, nor do rows without id. Vectors of different lengths have no inner product and
    aren't compared; empty ones have 0. Repeated ids with equal vectors count once as a query and once as a
    candidate. An id with several vectors is one query and one candidate: the score of two ids is the best over their
    vectors. Other columns are ignored. Empty tables give no rows.
    """
    return search(vectors, every, k, nodes, id_col, vector_col, scale)[0]


OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


def op9_topk_search(spark, sf_dir):
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
