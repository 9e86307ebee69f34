"""Fusing passages into evidence: dedupe, top k, source diversity, source relevance, stop and budget cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.planning import GOOD, enough
from ..functions.text import fingerprint
from ..functions.url import normalise

EVIDENCE, PER_SOURCE = 10, 4


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key in `order`."""
    return df.withColumn("__first", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__first = 1").drop("__first")


def dedupe_passages(rows: DataFrame, order: list, scope: str | None = "query_id", text_col: str = "text") -> DataFrame:
    """Of passages with one fingerprint the first met, by a hash of the fingerprint so that keys stay short."""
    keyed = rows.withColumn("__fp", F.sha2(fingerprint(F.col(text_col)), 256))
    return first_by(keyed, ([scope] if scope else []) + ["__fp"], order).drop("__fp")


def dedupe_urls(rows: DataFrame, order: list, url_col: str = "url") -> DataFrame:
    """First row of each normalised URL; rows whose URL can't be normalised are left out."""
    return first_by(rows.withColumn("__key", normalise(F.col(url_col))).where("__key IS NOT NULL"), ["__key"], order).drop("__key")


def dedupe_by_canonical(rows: DataFrame, canonicals: DataFrame, order: list) -> DataFrame:
    """First row of each canonical URL; `canonicals` has (url, canonical), the page's own URL where it has none."""
    named = rows.join(canonicals.select(F.col("url").alias("__u"), "canonical"), F.col("url") == F.col("__u"), "left")
    target = F.coalesce("canonical", "url")
    return first_by(named.withColumn("__key", F.coalesce(normalise(target), target)), ["__key"], order).drop("__key", "__u", "canonical")


def top_evidence(rows: DataFrame, scope: str = "query_id", source: str = "source_url", ties: tuple = ("encounter",), limit: int = EVIDENCE, per_source: int = PER_SOURCE) -> DataFrame:
    """The `limit` most relevant of each scope, and of these at most `per_source` of each source; `rank` tells their order."""
    order = [F.col("relevance").desc(), *ties]
    top = rows.withColumn("rank", F.row_number().over(W.partitionBy(scope).orderBy(*order))).where(F.col("rank") <= limit)
    own = F.row_number().over(W.partitionBy(scope, source).orderBy("rank"))
    return top.withColumn("__own", own).where(F.col("__own") <= per_source).drop("__own")


def source_relevance(sources: DataFrame, evidence: DataFrame, keys: tuple = ("query_id",)) -> DataFrame:
    """`sources` with relevance, the best of their evidence (0 without any)."""
    best = evidence.groupBy(*keys, F.col("source_url").alias("url")).agg(F.max("relevance").alias("__best"))
    return sources.join(best, [*keys, "url"], "left").withColumn("relevance", F.coalesce("__best", F.lit(0.0))).drop("__best")


def source_score(status: Column, title: Column) -> Column:
    """Half a point; more for 200 and for a title, less for errors; within [0, 1]."""
    made = F.lit(0.5) + F.when(status == 200, 0.2).when(status >= 400, -0.3).otherwise(0.0) + F.when(F.length(title) > 3, 0.1).otherwise(0.0)
    return F.least(F.greatest(made, F.lit(0.0)), F.lit(1.0))


def stop_prefix(rows: DataFrame, scope: str = "query_id", order: str = "rank", mode: str = "mode", good: str = "n_good") -> DataFrame:
    """Candidates until enough good passages have been found before them: `n_good` counts each one's relevance >= GOOD passages."""
    before = F.coalesce(F.sum(good).over(W.partitionBy(scope).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("good_before", before).where(F.col("good_before") < enough(F.col(mode)))


def budget_cut(rows: DataFrame, budget: Column, scope: str = "query_id", order: str = "rank", cost: str = "cost") -> DataFrame:
    """Requests whose running cost stays within `budget`."""
    used = F.sum(cost).over(W.partitionBy(scope).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)


def count_good(relevance: Column) -> Column:
    return F.count_if(relevance >= GOOD)
