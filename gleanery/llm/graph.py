"""Connected components over an edge table by alternating large-star and small-star contraction.

A hub's edges are dealt by node and salt: minima are folded per (node, salt), then per node, and go back to each salt,
so that the edges of one node never meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SALTS = 64


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _salt(other: str) -> Column:
    return F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")


def _with_least(rows: DataFrame) -> DataFrame:
    """`rows` (u, v) with m, the least v of all rows of u."""
    rows = rows.withColumn("salt", _salt("v"))
    parts = rows.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy(F.col("u").alias("w")).agg(F.min("m").alias("m"), F.collect_set("salt").alias("salts"))  # SALTS values at most
    back = least.select("w", "m", F.explode("salts").alias("s"))
    return rows.join(back, (F.col("u") == F.col("w")) & (F.col("salt") == F.col("s"))).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    moved = _with_least(_both(edges)).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    found = _with_least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = found.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(found.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: every node that isn't its component's least, and that least. `edges` has u and v of one ordered type.

    Self-loops and repeated edges count for nothing. Tables are written each turn, so that a lost executor costs one turn.
    """
    edges = materialise(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = materialise(small_star(large_star(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
