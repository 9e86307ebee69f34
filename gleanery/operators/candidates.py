"""Candidate URLs: scores, ranking, and repair of wrong URLs by similarity to observed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.planning import parse_time
from ..functions.text import tokens

# Weights of content types in a URL's score; others weigh 0.5, unknown ones 0.7.
TYPE_WEIGHTS = {
    "text/html": 1.0, "text/plain": 0.8, "text/markdown": 0.8, "application/json": 0.75, "application/xml": 0.7,
    "application/rss+xml": 0.65, "application/atom+xml": 0.65, "application/pdf": 0.6, "text/csv": 0.55,
}
REPAIR_MIN = 0.6


def recency(lastmod: Column, as_of: Column) -> Column:
    """exp(-age / 365 days); 0.5 where the date is missing or unreadable."""
    days = (F.unix_micros(as_of) - F.unix_micros(parse_time(lastmod))) / F.lit(86_400e6)
    return F.coalesce(F.exp(-days / F.lit(365.0)), F.lit(0.5))


def type_weight(mime: Column) -> Column:
    found = F.lit(0.5)
    for name, weight in TYPE_WEIGHTS.items():
        found = F.when(mime == name, weight).otherwise(found)
    return F.when(mime.isNull() | (mime == ""), 0.7).otherwise(found)


def query_overlap(url: Column, query: Column) -> Column:
    """Tokens of the URL that the query has, repeats counted, per distinct query token; may exceed 1."""
    asked = F.array_distinct(tokens(query))
    hits = F.size(F.filter(tokens(U.path_words(url)), lambda t: F.array_contains(asked, t)))
    return F.when(F.size(asked) > 0, hits / F.size(asked).cast("double")).otherwise(F.lit(0.0))


def anchor_overlap(anchor: Column, query: Column) -> Column:
    asked = F.array_distinct(tokens(query))
    hits = F.size(F.array_intersect(F.array_distinct(tokens(F.coalesce(anchor, F.lit("")))), asked))
    return F.when(F.size(asked) > 0, hits / F.size(asked).cast("double")).otherwise(F.lit(0.0))


def url_score(url: Column, query: Column, base: Column, as_of: Column, anchor: Column | None = None, mime: Column | None = None, lastmod: Column | None = None, priority: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    shallow = F.greatest(F.lit(0.0), F.lit(1.0) - U.depth(url).cast("double") * F.lit(0.1))
    raw = (
        query_overlap(url, query) * F.lit(0.4)
        + anchor_overlap(anchor if anchor is not None else null, query) * F.lit(0.2)
        + shallow * F.lit(0.1)
        + type_weight(mime if mime is not None else null) * F.lit(0.1)
        + recency(lastmod if lastmod is not None else null, as_of) * F.lit(0.05)
        + F.coalesce((priority if priority is not None else F.lit(None).cast("double")) * F.lit(0.1), F.lit(0.0))
        + F.when(U.origin(url) == U.origin(base), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), raw)


def rank_candidates(rows: DataFrame, keep: Column, scope: str = "query_id", order: tuple = ("pos",)) -> DataFrame:
    """Best-scored candidates of each scope, `rank` from 1, up to `keep`."""
    rank = F.row_number().over(W.partitionBy(scope).orderBy(F.col("score").desc(), *order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= keep)


def path_similarity(asked_path: Column, seen_path: Column) -> Column:
    """Jaccard of path tokens, plus soft prefix matches, same parent and same extension; at most 1."""
    a, b = U.repair_tokens(asked_path), U.repair_tokens(seen_path)
    x, y = F.array_distinct(a), F.array_distinct(b)
    jaccard = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)).cast("double")
    close = lambda r, c: (r != c) & (F.startswith(r, c) | F.startswith(c, r)) & (F.least(F.length(r), F.length(c)) >= 4)
    soft = F.size(F.filter(x, lambda r: F.exists(y, lambda c: close(r, c)))) / F.greatest(F.size(x), F.size(y)).cast("double")
    parent = F.when(U.parent(asked_path) == U.parent(seen_path), 0.1).otherwise(0.0)
    same = F.when((U.extension(asked_path) != "") & (U.extension(asked_path) == U.extension(seen_path)), 0.05).otherwise(0.0)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.least(F.lit(1.0), jaccard + soft * F.lit(0.4) + parent + same))


def match_score(asked: Column, seen: Column, anchor: Column, priority: Column) -> Column:
    a = U.repair_tokens(U.path(asked))
    named = F.array_distinct(U.repair_tokens(F.coalesce(anchor, F.lit(""))))
    hits = F.size(F.filter(a, lambda t: F.array_contains(named, t)))
    bonus = F.when(F.size(a) > 0, F.least(F.lit(0.3), hits / F.size(a).cast("double") * F.lit(0.4))).otherwise(0.0)
    return F.least(F.lit(1.0), path_similarity(U.path(asked), U.path(seen)) + bonus + F.coalesce(priority * F.lit(0.1), F.lit(0.0)))


def repair_urls(asked: DataFrame, observed: DataFrame) -> DataFrame:
    """query_id, url, resolved, method, resolved_url, reason for each row of `asked` (query_id, url, canonical).

    `observed` has (url, pos, anchor_text, priority). Exact, then normalised, then the server's canonical if observed, then the
    most similar observed URL of the same origin from REPAIR_MIN on, ties to the smaller pos; never a URL that wasn't observed.
    Each step is an equi-join: the similarity join too, on the origin.
    """
    seen = observed.select("url", "pos", "anchor_text", "priority", U.normalise(F.col("url")).alias("norm"), U.origin(F.col("url")).alias("origin"))
    exact = seen.select(F.col("url").alias("exact")).distinct()
    by_norm = seen.where("norm IS NOT NULL").groupBy("norm").agg(F.min_by("url", "pos").alias("norm_url"))
    rows = asked.withColumn("__norm", U.normalise(F.col("url"))).withColumn("__canon", U.normalise(F.col("canonical"))).withColumn("__origin", U.origin(F.col("url")))
    scored = rows.select("query_id", "url", "__origin").join(seen.withColumnRenamed("url", "seen"), F.col("__origin") == F.col("origin"))
    scored = scored.withColumn("score", match_score(F.col("url"), F.col("seen"), F.col("anchor_text"), F.col("priority"))).where(F.col("score") >= REPAIR_MIN)
    best = scored.groupBy("query_id").agg(F.max_by("seen", F.struct("score", -F.col("pos"))).alias("similar"))
    canon = by_norm.select(F.col("norm").alias("canon_norm"), F.col("norm_url").alias("canon_url"))
    out = rows.join(exact, F.col("url") == F.col("exact"), "left").join(by_norm, F.col("__norm") == F.col("norm"), "left").join(canon, F.col("__canon") == F.col("canon_norm"), "left").join(best, "query_id", "left")
    found = F.coalesce("exact", "norm_url", "canon_url", "similar")
    method = F.when(F.col("exact").isNotNull(), "exact").when(F.col("norm_url").isNotNull(), "normalised").when(F.col("canon_url").isNotNull(), "canonical").when(F.col("similar").isNotNull(), "path_similarity").otherwise("none")
    return out.select("query_id", "url", found.isNotNull().alias("resolved"), method.alias("method"), found.alias("resolved_url"), F.when(found.isNull(), "no_safe_url_match").alias("reason"))


def find_in_sitemap(urls: DataFrame, entries: DataFrame) -> DataFrame:
    """Each URL's first sitemap entry by raw or else normalised URL: two equi-joins instead of an OR."""
    raw = entries.groupBy(F.col("url").alias("__raw")).agg(F.min_by(F.struct("url", "lastmod", "priority"), "pos").alias("e1"))
    norm = entries.withColumn("__n", U.normalise(F.col("url"))).where("__n IS NOT NULL").groupBy("__n").agg(F.min_by(F.struct("url", "lastmod", "priority"), "pos").alias("e2"))
    found = urls.join(raw, F.col("url") == F.col("__raw"), "left").join(norm, U.normalise(F.col("url")) == F.col("__n"), "left").withColumn("entry", F.coalesce("e1", "e2"))
    return found.select("url", F.col("entry.url").alias("entry_url"), F.col("entry.lastmod").alias("lastmod"), F.col("entry.priority").alias("priority"))
