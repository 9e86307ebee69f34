"""URL algebra as Column expressions. Built on regular expressions: parse_url raises on what browsers accept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters without content.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "msclkid", "mc_eid", "yclid", "ref", "_ga", "igshid"]

_URL = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _URL, 2))


def port(url: Column) -> Column:
    """The port, also where it is the scheme's own; null for other schemes without one."""
    given = F.expr("try_cast(NULL AS int)") if url is None else F.regexp_extract(url, _URL, 3).try_cast("int")
    return F.coalesce(given, F.when(scheme(url) == "http", 80).when(scheme(url) == "https", 443))


def path(url: Column) -> Column:
    found = F.regexp_extract(url, _URL, 4)
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, _URL, 5), r"^\?", "")


def is_http(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (host(url) != ""), F.lit(False))


def _default_port(url: Column) -> Column:
    given = F.regexp_extract(url, _URL, 3)
    return (given == "") | ((scheme(url) == "http") & (given == "80")) | ((scheme(url) == "https") & (given == "443"))


def origin(url: Column) -> Column:
    """scheme://host[:port], the port only where it isn't the scheme's own; null for what isn't http(s)."""
    shown = F.when(_default_port(url), "").otherwise(F.concat(F.lit(":"), F.regexp_extract(url, _URL, 3)))
    return F.when(is_http(url), F.concat(scheme(url), F.lit("://"), host(url), shown))


def remove_dots(path_: Column) -> Column:
    """Path with its . and .. segments resolved."""
    parts = F.split(F.regexp_replace(path_, "^/", ""), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).when(p == ".", out).otherwise(F.concat(out, F.array(p))))
    made = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(F.regexp_like(path_, F.lit(r"(^|/)\.\.?(/|$)")), made).otherwise(path_)


def resolve(href: Column, base: Column) -> Column:
    """An absolute URL for `href` found on page `base`; null if `base` isn't http(s) or href has another scheme."""
    clean = F.trim(href)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    tail = F.regexp_extract(clean, r"(?s)([?#].*)?$", 1)
    body = F.regexp_replace(clean, r"(?s)[?#].*$", "")
    bare_query = F.regexp_extract(base, _URL, 5)
    joined = (
        F.when(F.regexp_like(clean, F.lit("^(?i)https?://")), F.concat(origin(clean), remove_dots(path(clean)), F.regexp_extract(clean, _URL, 5), F.regexp_extract(clean, _URL, 6)))
        .when(F.startswith(clean, F.lit("//")), F.concat(scheme(base), F.lit(":"), clean))
        .when(F.regexp_like(clean, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
        .when(clean == "", F.concat(origin(base), path(base), bare_query))
        .when(F.startswith(clean, F.lit("#")), F.concat(origin(base), path(base), bare_query, clean))
        .when(F.startswith(clean, F.lit("?")), F.concat(origin(base), path(base), clean))
        .when(F.startswith(clean, F.lit("/")), F.concat(origin(base), remove_dots(body), tail))
        .otherwise(F.concat(origin(base), remove_dots(F.concat(folder, body)), tail))
    )
    return F.when(is_http(base) | F.regexp_like(clean, F.lit("^(?i)https?://")), joined)


def normalise(url: Column) -> Column:
    """Fragment, default port, tracking parameters and one trailing slash removed; parameters in stable order of
    name; scheme and host in lower case. Null for what isn't http(s)."""
    params = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).isin(TRACKING))
    name = lambda p: F.regexp_extract(p, "^([^=]*)", 1)
    ordered = F.array_sort(params, lambda a, b: F.when(name(a) < name(b), -1).when(name(a) > name(b), 1).otherwise(0))
    place = remove_dots(path(url))
    trimmed = F.when(F.length(place) > 1, F.regexp_replace(place, "/$", "")).otherwise(place)
    asked = F.when(F.size(ordered) > 0, F.concat(F.lit("?"), F.array_join(ordered, "&"))).otherwise("")
    return F.when(is_http(url), F.concat(origin(url), trimmed, asked))


def path_words(url: Column) -> Column:
    """Host and path as text: dots, slashes, dashes and underscores become blanks."""
    return F.concat(F.translate(host(url), ".", " "), F.lit(" "), F.translate(path(url), "/-_.", "    "))


def depth(url: Column) -> Column:
    return F.size(F.filter(F.split(path(url), "/"), lambda s: s != ""))


def repair_tokens(text: Column) -> Column:
    """Lower-case pieces of a path or anchor, longer than one character; neither stemmed nor filtered."""
    return F.filter(F.split(F.lower(text), r"[/\-_. ]"), lambda t: F.length(t) > 1)


def parent(path_: Column) -> Column:
    return F.regexp_replace(path_, "/[^/]*$", "")


def extension(path_: Column) -> Column:
    return F.when(F.contains(path_, F.lit(".")), F.lower(F.substring_index(path_, ".", -1))).otherwise("")


def safe_port(value: Column) -> Column:
    return F.coalesce(value.isin(80, 443, 8080, 8443), F.lit(True))


def url_error(url: Column) -> Column:
    """INVALID_URL, UNSAFE_SCHEME or UNSAFE_PORT, the first that applies; null for a usable URL."""
    return (
        F.when(url.isNull() | ~F.regexp_like(F.coalesce(url, F.lit("")), F.lit(r"^\s*[A-Za-z][A-Za-z0-9+.-]*:")), "INVALID_URL")
        .when(~F.regexp_like(url, F.lit(r"^\s*(?i)https?:")), "UNSAFE_SCHEME")
        .when(~is_http(url), "INVALID_URL")
        .when(~safe_port(port(url)), "UNSAFE_PORT")
    )
