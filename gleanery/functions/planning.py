"""Query planning: mode, budgets, token expansion, retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Synonyms by token.
SYNONYMS = {
    "auth": ["authentication", "authorisation", "authorization", "login", "oauth"],
    "authentication": ["auth", "login", "oauth", "sso"],
    "api": ["endpoint", "rest", "graphql", "interface"],
    "error": ["exception", "failure", "bug", "issue", "problem"],
    "config": ["configuration", "setup", "settings", "options"],
    "install": ["installation", "setup", "getting started"],
    "deploy": ["deployment", "release", "publish", "ship"],
    "performance": ["speed", "latency", "throughput", "benchmark"],
    "security": ["auth", "permission", "access", "role", "policy"],
    "database": ["db", "storage", "sql", "postgres", "mysql", "sqlite"],
    "latest": ["recent", "new", "current", "updated", "version"],
}

# Substrings that ask for a deep search.
DEEP_SIGNALS = ["all", "every", "complete", "comprehensive", "latest", "recent", "full", "entire", "list all", "list every"]

# Mode, pages, requests, good passages that suffice.
BUDGETS = [("fast", 2, 4, 1), ("balanced", 6, 8, 3), ("deep", 12, 16, 8)]
GOOD = 0.6


def infer_mode(query: Column) -> Column:
    low = F.lower(query)
    return F.when(F.regexp_like(low, F.lit("|".join(DEEP_SIGNALS))), "deep").when(F.size(F.split(low, r"\s+")) <= 4, "fast").otherwise("balanced")


def _by_mode(mode: Column, column: int) -> Column:
    found = F.lit(None).cast("int")
    for row in BUDGETS:
        found = F.when(mode == row[0], row[column]).otherwise(found)
    return found


def max_pages(mode: Column, given: Column | None = None) -> Column:
    return F.coalesce(given, _by_mode(mode, 1)) if given is not None else _by_mode(mode, 1)


def max_requests(mode: Column, given: Column | None = None) -> Column:
    return F.coalesce(given, _by_mode(mode, 2)) if given is not None else _by_mode(mode, 2)


def enough(mode: Column) -> Column:
    return _by_mode(mode, 3)


def expand_tokens(query: Column) -> Column:
    """Distinct tokens of the query, then those of the synonyms of each; lookups are by stemmed token."""
    base = tokens(query)
    table = F.create_map(*[x for key, words in SYNONYMS.items() for x in (F.lit(key), tokens(F.lit(" ".join(words))))])
    more = F.flatten(F.transform(base, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(base, more))


def retry_delay_ms(retry_after: Column, attempt: Column, as_of: Column, base_ms: int = 1000, cap_ms: int = 30_000) -> Column:
    """Retry-After as seconds or as an HTTP date relative to `as_of`, else exponential back-off; capped."""
    seconds = F.regexp_extract(F.coalesce(retry_after, F.lit("")), r"^\s*\+?(\d+)", 1).try_cast("bigint")
    date = F.try_to_timestamp(F.regexp_extract(F.coalesce(retry_after, F.lit("")), r"(\d{2} \w{3} \d{4} \d{2}:\d{2}:\d{2}) GMT", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    late = F.when(date.isNotNull(), F.greatest(F.ceil((F.unix_micros(date) - F.unix_micros(as_of)) / 1e6), F.lit(0)))
    given = F.coalesce(seconds, late) * 1000
    return F.least(F.coalesce(given, (base_ms * F.pow(F.lit(2.0), attempt)).cast("bigint")), F.lit(cap_ms)).cast("bigint")


def retryable(status: Column) -> Column:
    return status.isin(429, 503)


def parse_time(text: Column) -> Column:
    """ISO dates and times; null for anything else."""
    return F.try_to_timestamp(text)
