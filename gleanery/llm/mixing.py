"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Each source has a weight and a size (its words). The budget is shared by weight; a source is clamped at
`max_epochs` times its size and the excess goes to the rest, in proportion to weight, until none is above.
That fixed point has a closed form: in order of size/weight the clamped sources are a prefix, found with
running sums over the (small) table of sources.

Repetitions are seeded: every row is taken floor(target / size) times, and the fractional repetition goes
to a seeded order of the source's rows until the target's remainder is used up; the row at the border gives
the leading words that are missing. The running sum is kept in two levels (seeded bucket, then row), so that a
source with a third of all rows is spread over 16**BUCKET_DIGITS window groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BUCKET_DIGITS = 3  # hexadecimal: 4096 buckets of a source


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target from one row per source (source, source_size).

    Sources in order of code points, null last, weigh `weights`, repeating; the targets' sum is the sizes' sum.
    """
    wide = lambda name: F.col(name).cast("decimal(19,0)")  # noqa: E731  products of two longs
    every = W.partitionBy(F.lit(0))
    named = sizes.withColumn("__at", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * F.lit(max_epochs)
    rising = every.orderBy((F.col("__cap") / F.col("weight")).asc(), F.col("__at").asc()).rowsBetween(W.unboundedPreceding, -1)
    filled = (
        named.withColumn("weight", weight)
        .withColumn("__cap", cap)
        .withColumn("__left", F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(rising), F.lit(0)))
        .withColumn("__share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(rising), F.lit(0)))
        # in rising order of cap/weight, a source is clamped if its share of what the ones before leave exceeds its cap
        .withColumn("__clamped", wide("weight") * wide("__left") > wide("__cap") * wide("__share"))
        .withColumn("__rest", F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("__clamped"), F.col("__cap"))).over(every), F.lit(0)))
        .withColumn("__open", F.coalesce(F.sum(F.when(~F.col("__clamped"), F.col("weight"))).over(every), F.lit(1)))
    )
    target = F.when(F.col("__clamped"), F.col("__cap").cast("double")).otherwise((F.col("weight") * F.col("__rest")).cast("double") / F.col("__open").cast("double"))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """One row per row of `docs`: doc_id, size, source, source_size, target, repetitions, partial, taken.

    `taken` = repetitions * size + partial words. Null or empty texts have size 0 and take nothing; a source of
    size 0 has target 0; null is a source of its own; repeated rows count each. The seeded order is by a hash of
    id and size, so reruns agree; rows alike in both are interchangeable. Other columns are ignored. Texts of any
    length are counted whole; an empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    return _decided(rows, ["__order", "doc_id"], weights, max_epochs, seed)


def _decided(rows: DataFrame, order: list[str], weights, max_epochs: int, seed: int) -> DataFrame:
    """rows (doc_id, source, size and others, which stay) with the mix's columns; a bucket's rows are taken in `order`."""
    own = rows.columns
    named = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("size").cast("string"))
    rows = rows.withColumn("__order", F.sha2(named, 256)).withColumn("__bucket", F.substring("__order", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "__bucket").agg(F.sum("size").alias("__sum"))
    targets = source_targets(buckets.groupBy("source").agg(F.sum("__sum").alias("source_size")), weights, max_epochs)
    before = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.withColumn("__start", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select("source", "__bucket", "__start")
    # one key that is never null for window and join, so that rows, which may carry texts, are exchanged once
    group = F.concat(F.col("__bucket"), F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("+"), "source")))
    plan = (
        starts.withColumn("__group", group)
        .withColumnRenamed("source", "__source")
        .join(targets, F.col("__source").eqNullSafe(F.col("source")))
        .select("__group", "__start", "source_size", "target")
    )
    inside = W.partitionBy("__group").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    extra = F.floor(F.col("target") - F.col("repetitions") * F.col("source_size")).cast("long")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__extra") - F.col("__start") - F.col("__inside"))).cast("long")
    return (
        rows.withColumn("__group", group)
        .withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(plan, "__group")
        .withColumn("repetitions", whole)
        .withColumn("__extra", extra)
        .withColumn("partial", partial)
        .select("doc_id", "size", "source", "source_size", "target", "repetitions", "partial", (F.col("repetitions") * F.col("size") + F.col("partial")).alias("taken"), *own[3:])
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 42) -> DataFrame:
    """`docs` with each row repeated as the mix takes it, all columns kept and texts whole: a partial repetition
    of at least half a row's words counts as one, a smaller one as none. Every row, also one whose id is null or
    repeats, has its own decision; rows alike in id and size are taken in the order of their text keys."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), text_key(text_col).alias("__key"), F.struct("*").alias("__row"))
    taken = _decided(rows, ["__order", "doc_id", "__key"], weights, max_epochs, seed)
    times = F.col("repetitions") + (F.col("partial") * 2 >= F.greatest(F.col("size"), F.lit(1))).cast("long")
    taken = taken.select("__row", times.cast("int").alias("__times")).where("__times > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__times")))).select("__row.*")


OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             CAST(row_number() OVER (ORDER BY source NULLS LAST) AS INTEGER) AS nth FROM d GROUP BY source),
fill(step, capped) AS (
  SELECT 0, CAST([] AS INTEGER[])
  UNION ALL
  SELECT step + 1, (SELECT coalesce(list(nth), CAST([] AS INTEGER[])) FROM s,
      (SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (list_contains(capped, nth)), 0) AS rest, sum(weight) FILTER (NOT list_contains(capped, nth)) AS open FROM s) r
      WHERE list_contains(capped, nth) OR weight * r.rest > 3 * source_size * r.open)
  FROM fill WHERE step < 30),
last AS (SELECT capped FROM fill WHERE step = 30),
t AS (SELECT s.source, source_size, CASE WHEN list_contains(capped, nth) THEN CAST(3 * source_size AS DOUBLE)
       ELSE CAST(weight * ((SELECT sum(source_size) FROM s) - (SELECT coalesce(sum(3 * source_size), 0) FROM s, last WHERE list_contains(capped, nth))) AS DOUBLE)
            / CAST((SELECT sum(weight) FROM s, last WHERE NOT list_contains(capped, nth)) AS DOUBLE) END AS target FROM s, last),
o AS (SELECT doc_id, d.source, size, source_size, target, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY sha256('42|' || doc_id || '|' || size), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM o
"""


def op6_mixing(spark, sf_dir):
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
