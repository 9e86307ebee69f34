"""Query intent and query variants as Column expressions: rules over words, no model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let, raw_words

# Words that hint at an intent; a query has the intent if one of its words is listed.
SIGNALS = {
    "high": ["latest", "current", "today", "now", "news", "price"],
    "medium": ["recent", "version", "release", "update", "updated"],
    "technical": ["api", "error", "specification", "documentation", "install", "config", "middleware", "sdk"],
    "scholarly": ["paper", "research", "study", "journal", "exam"],
    "news_like": ["news", "announcement", "today", "release"],
    "document_like": ["pdf", "report", "paper", "specification", "documentation"],
    "structured_data_like": ["price", "table", "dataset", "csv", "json", "statistics"],
}
FILLERS = ["how", "does", "do", "did", "what", "is", "are", "the", "a", "an", "why", "when", "where", "which", "who", "can", "to", "of", "in", "on", "for", "work", "works"]


def _has(words: Column, kind: str) -> Column:
    return F.exists(words, lambda w: w.isin(SIGNALS[kind]))


def query_intent(query: Column) -> Column:
    """struct<freshness, technical, scholarly, news_like, document_like, structured_data_like>; freshness is high, medium or low."""
    words = raw_words(F.coalesce(query, F.lit("")))

    def flags(w: Column) -> Column:
        freshness = F.when(_has(w, "high"), "high").when(_has(w, "medium"), "medium").otherwise("low")
        return F.struct(freshness.alias("freshness"), *[_has(w, kind).alias(kind) for kind in list(SIGNALS)[2:]])

    return let(words, flags)


def query_variants(query: Column, enabled: Column | None = None) -> Column:
    """Up to four distinct forms of a query: as asked, its content words, and these with `documentation` or `latest` as the intent has it.

    Trailing question marks and dots are dropped. With `enabled` false only the query as asked; an empty or null query has none.
    """
    asked = F.regexp_replace(collapse(F.coalesce(query, F.lit(""))), r"[?.! ]+$", "")
    content = F.array_join(F.filter(F.split(asked, " "), lambda w: ~F.lower(w).isin(FILLERS)), " ")

    def made(s: Column) -> Column:
        more = F.array(
            s["content"],
            F.when(s["intent"]["technical"] & ~F.contains(F.lower(s["content"]), F.lit("documentation")), F.concat(s["content"], F.lit(" documentation"))),
            F.when((s["intent"]["freshness"] != "low") & ~F.contains(F.lower(s["content"]), F.lit("latest")), F.concat(F.lit("latest "), s["content"])),
        )
        first = F.array(s["asked"])
        forms = F.when(s["content"] != "", F.concat(first, more)).otherwise(first)
        if enabled is not None:
            forms = F.when(enabled, forms).otherwise(first)
        return F.filter(F.array_distinct(forms), lambda v: v.isNotNull() & (v != ""))

    return let(F.struct(asked.alias("asked"), content.alias("content"), query_intent(query).alias("intent")), made)


__all__ = ["query_intent", "query_variants"]
