"""Content types from headers and first bytes, and size limits, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Other names of content types.
ALIASES = {
    "text/xml": "application/xml", "application/x-rss+xml": "application/rss+xml", "application/x-atom+xml": "application/atom+xml", "application/xhtml+xml": "text/html",
    "text/javascript": "application/javascript", "application/x-javascript": "application/javascript", "image/jpg": "image/jpeg",
}

# Types that servers send for anything.
VAGUE = ["application/octet-stream", "binary/octet-stream", "text/plain", "application/xml", "text/xml", "", "unknown"]

# First bytes in hexadecimal.
MAGIC = [("255044462D", "application/pdf"), ("504B0304", "application/zip"), ("FFD8FF", "image/jpeg"), ("89504E470D0A1A0A", "image/png"), ("474946383761", "image/gif"), ("474946383961", "image/gif")]

# How texts begin.
TEXT_MAGIC = [
    (r"(?i)^<\?xml\s", "application/xml"), (r"(?i)^<rss[\s>]", "application/rss+xml"), (r"(?i)^<feed[\s>]", "application/atom+xml"),
    (r"(?i)^<!doctype\s+html", "text/html"), (r"(?i)^<html[\s>]", "text/html"), (r"^[{\[]", "application/json"),
]

PREVIEW = 512
HTML_LIMIT, PDF_LIMIT, BOMB_RATIO = 2 * 1024 * 1024, 15 * 1024 * 1024, 100


def normalise_mime(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


def canonical_mime(mime: Column) -> Column:
    found = mime
    for alias, name in ALIASES.items():
        found = F.when(mime == alias, name).otherwise(found)
    return found


def sniff(body: Column) -> Column:
    """Type by the first bytes, or null. Only PREVIEW bytes are looked at."""
    head = F.hex(F.substring(body, 1, 12))
    text = F.regexp_replace(F.decode(F.substring(body, 1, PREVIEW), "ISO-8859-1"), r"^[\s\xA0]+", "")
    found = F.lit(None).cast("string")
    rules = [(F.startswith(head, F.lit(code)), mime) for code, mime in MAGIC]
    rules.append((F.startswith(head, F.lit("52494646")) & F.contains(head, F.lit("57454250")), "image/webp"))
    rules += [(F.regexp_like(text, F.lit(pattern)), mime) for pattern, mime in TEXT_MAGIC]
    for hit, mime in reversed(rules):
        found = F.when(hit, mime).otherwise(found)
    return found


def detect(header: Column, body: Column) -> Column:
    """A specific header wins, then the bytes, then a vague header, then 'unknown'."""
    mime = normalise_mime(header)
    given = F.when(mime != "", canonical_mime(mime))
    return F.when(~mime.isin(VAGUE), canonical_mime(mime)).otherwise(F.coalesce(sniff(body), given, F.lit("unknown")))


def body_error(body: Column, declared: Column, limit: int = HTML_LIMIT) -> Column:
    """RESPONSE_TOO_LARGE or COMPRESSION_BOMB by declared and real length; null if neither."""
    size = F.octet_length(body)
    return F.when(F.coalesce(declared, F.lit(0)) > limit, "RESPONSE_TOO_LARGE").when(size > limit, "RESPONSE_TOO_LARGE").when((declared > 0) & (size > declared * BOMB_RATIO), "COMPRESSION_BOMB")
