"""DuckDB forms of the registered queries."""

from __future__ import annotations

from ..functions.planning import SYNONYMS
from ..functions.text import STOPWORDS
from . import fixtures as X

SYNONYM_ROWS = "VALUES " + ", ".join("('" + key + "', '" + " ".join(words) + "')" for key, words in SYNONYMS.items())


def _stem(w: str) -> str:
    return f"""CASE WHEN length({w}) <= 3 THEN {w}
      WHEN {w} LIKE '%ings' AND length({w}) > 6 THEN {w}[:-5] WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN {w}[:-4]
      WHEN {w} LIKE '%tions' THEN {w}[:-6] WHEN {w} LIKE '%tion' THEN {w}[:-5] WHEN {w} LIKE '%ments' THEN {w}[:-6] WHEN {w} LIKE '%ment' THEN {w}[:-5]
      WHEN ({w} LIKE '%able' OR {w} LIKE '%ible' OR {w} LIKE '%ness') AND length({w}) > 6 THEN {w}[:-5]
      WHEN {w} LIKE '%ers' AND length({w}) > 5 THEN {w}[:-4] WHEN {w} LIKE '%er' AND length({w}) > 4 THEN {w}[:-3] WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN {w}[:-3]
      WHEN {w} LIKE '%ies' AND length({w}) > 4 THEN {w}[:-4] || 'y' WHEN {w} LIKE '%es' AND length({w}) > 4 THEN {w}[:-3]
      WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN {w}[:-2] ELSE {w} END"""


_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tokens(x: str) -> str:
    return f"list_transform(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: length(t) > 1 AND NOT list_contains({_STOP}, t)), lambda w: {_stem('w')})"


_Q = f"'{X.QUERY}'"
_TERMS = f"SELECT doc_id, unnest({_tokens('text')}) AS term FROM documents"
_CHUNKS = """SELECT doc_id, source, i AS window_no, i * 650 AS char_offset, substr(body, i * 650 + 1, 800) AS text
  FROM (SELECT doc_id, source, body, unnest(generate_series(0, greatest(CAST(ceil((length(body) - 800) / 650.0) AS INTEGER), 0))) AS i
        FROM (SELECT doc_id, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents) WHERE body <> '')"""
_PASSAGES = f"""WITH c AS ({_CHUNKS}), q AS (SELECT DISTINCT unnest({_tokens(_Q)}) AS term),
t AS (SELECT doc_id, source, window_no, char_offset, text, {_tokens('text')} AS toks FROM c),
s AS (SELECT *, CAST(len(toks) AS DOUBLE) AS n, avg(len(toks)) OVER (PARTITION BY doc_id) AS mean, CAST(count(*) OVER (PARTITION BY doc_id) AS DOUBLE) AS total FROM t),
f AS (SELECT s.*, q.term, CAST(len(list_filter(toks, lambda x: x = q.term)) AS DOUBLE) AS tf FROM s, q),
d AS (SELECT *, CAST(count(*) FILTER (tf > 0) OVER (PARTITION BY doc_id, term) AS DOUBLE) AS df FROM f),
r AS (SELECT doc_id, source, window_no, char_offset, text, sum(CASE WHEN tf > 0 THEN ln((total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) ELSE 0 END) AS raw
      FROM d GROUP BY ALL),
m AS (SELECT *, raw / nullif(max(raw) OVER (PARTITION BY doc_id), 0) AS relevance FROM r),
p AS (SELECT * FROM m WHERE relevance >= 0.05 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY relevance DESC, window_no) <= 8)"""
_FP = r"substr(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 200)"

_SCHEME, _HOST = "lower(regexp_extract(url, '^([A-Za-z]+)://', 1))", "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END"
_PARTS = f"SELECT page_id, url, {_SCHEME} AS scheme, {_HOST} AS host, {_PATH} AS path, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM pages"
_TRACKING = "['utm_source','utm_medium','utm_campaign','utm_term','utm_content','utm_id','fbclid','gclid','msclkid','mc_eid','yclid','ref','_ga','igshid']"
_NORM = f"""WITH u AS ({_PARTS}),
k AS (SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains({_TRACKING}, split_part(p, '=', 1)))) AS ps FROM u),
n AS (SELECT page_id, url, scheme || '://' || host AS origin, path, scheme || '://' || host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END
        || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS normalised FROM k)"""
_ANCHORS = r"""SELECT page_id, url, pos - 1 AS pos, hrefs[pos] AS href, regexp_replace(regexp_replace(regexp_replace(inners[pos], '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS anchor_text
  FROM (SELECT page_id, url, hrefs, inners, unnest(generate_series(1, len(hrefs))) AS pos
        FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>', 2) AS inners FROM pages))
  WHERE hrefs[pos] <> '' AND hrefs[pos] NOT LIKE '#%'"""
_LINKS = f"""WITH a AS ({_ANCHORS}), o AS (SELECT page_id, {_SCHEME} || '://' || {_HOST} AS origin, {_PATH} AS path FROM pages),
l AS (SELECT page_id, origin || href AS link, href, anchor_text, pos, path FROM a JOIN o USING (page_id) QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1)"""
_TITLE = r"regexp_replace(regexp_extract(html, '(?is)<title[^>]*>\s*([^<\s].*?)</title>', 1), '^\s+|\s+$', '', 'g')"
_SCORE = f"""WITH u AS ({_PARTS}), w AS (SELECT *, {_tokens("replace(host, '.', ' ') || ' ' || translate(path, '/-_.', '    ')")} AS toks, list_distinct({_tokens("'english thing 825 example'")}) AS asked FROM u),
s AS (SELECT page_id, scheme || '://' || host AS origin, round(least(1.0::DOUBLE, len(list_filter(toks, lambda t: list_contains(asked, t))) / CAST(len(asked) AS DOUBLE) * 0.4::DOUBLE
   + greatest(0.0::DOUBLE, 1.0::DOUBLE - len(list_filter(string_split(path, '/'), lambda x: x <> '')) * 0.1::DOUBLE) * 0.1::DOUBLE + 0.7::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.05::DOUBLE
   + CASE WHEN scheme || '://' || host = 'https://www.spam-farm.example.org' THEN 0.1::DOUBLE ELSE 0 END), 6) AS score FROM w)"""
_RTOK = "list_filter(string_split_regex(lower({0}), '[/\\-_. ]'), lambda t: length(t) > 1)"
_QUERIES = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in X.QUERIES) + ") v(query_id, query)"
_MODE = r"""CASE WHEN regexp_matches(lower(query), 'all|every|complete|comprehensive|latest|recent|full|entire') THEN 'deep' WHEN len(regexp_split_to_array(lower(query), '\s+')) <= 4 THEN 'fast' ELSE 'balanced' END"""


def _values(names: str, rows: list) -> str:
    show = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else f"'{v}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) v({names})"


# Queries over the inline tables of fixtures.py: the tests run them; derived.py registers them over whole tables.
FIXTURES = [
    "url_repair", "resolve_budget", "expand_tokens", "robots_groups", "robots_allowed", "ssrf_ipv4", "ssrf_ipv6", "safe_port", "url_error", "redirect_chain", "retry_delay", "mime_detect", "sitemap_entries", "sitemap_discovery",
    "feed_items",
]


_ANSWERS = """WITH a AS (SELECT conv_id * 100 + turn AS query_id, 'https://a.com/' || conv_id AS url, text AS body, CASE WHEN turn % 3 = 0 THEN 0 WHEN conv_id % 2 = 0 THEN 6 ELSE 1 END AS n,
    CASE WHEN turn % 3 = 0 THEN 'not_found' ELSE 'success' END AS status, turn % 4 <> 0 AS resolved, CASE WHEN turn % 4 <> 0 THEN 'https://a.com/' || conv_id || CASE WHEN turn % 2 = 0 THEN '' ELSE '/new' END END AS resolved_url,
    CASE WHEN turn % 4 = 0 AND conv_id % 2 = 0 THEN 'no_safe_url_match' END AS reason FROM conversations WHERE text IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    """The registered queries' forms."""
    from .derived_sql import derived_sql
    from .signals_sql import signals_sql

    return {name: sql for name, sql in inline_sql().items() if name not in FIXTURES} | derived_sql() | signals_sql()


def inline_sql() -> dict[str, str]:
    """Forms of the queries in queries.py, those over inline tables included."""
    out = {
        "tokenize_terms": f"SELECT doc_id, term, count(*) AS tf FROM ({_TERMS}) GROUP BY ALL",
        "term_df": f"SELECT term, count(DISTINCT doc_id) AS df FROM ({_TERMS}) GROUP BY term",
        "bm25_corpus": f"""WITH t AS ({_TERMS}), l AS (SELECT doc_id, count(term) AS n FROM documents LEFT JOIN t USING (doc_id) GROUP BY doc_id),
          c AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(n) AS mean FROM l), q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({_tokens(_Q)}) AS term) GROUP BY term),
          h AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS tf FROM t JOIN q USING (term) GROUP BY ALL), f AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM h GROUP BY term),
          r AS (SELECT doc_id, sum(qtf * ln((total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS raw
                FROM h JOIN f USING (term) JOIN q USING (term) JOIN l USING (doc_id), c GROUP BY doc_id)
          SELECT 1 AS query_id, CAST(row_number() OVER (ORDER BY raw DESC, doc_id) AS INTEGER) AS rank, doc_id, round(raw / max(raw) OVER (), 6) AS score FROM r QUALIFY rank <= 10""",
        "bm25_passages": f"{_PASSAGES} SELECT doc_id, window_no, char_offset, round(relevance, 6) AS relevance FROM p",
        "passage_windows": f"SELECT doc_id, window_no, char_offset, text FROM ({_CHUNKS})",
        "dedupe_passages": f"SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, {_FP} AS fp FROM documents) WHERE fp IS NOT NULL GROUP BY fp",
        "evidence_top10_diverse": f"""{_PASSAGES}, x AS (SELECT *, {_FP} AS fp FROM p), y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY fp ORDER BY doc_id, window_no) = 1),
          z AS (SELECT doc_id, window_no, source, round(relevance, 6) AS relevance, CAST(row_number() OVER (ORDER BY round(relevance, 6) DESC, doc_id, window_no) AS INTEGER) AS rank FROM y QUALIFY rank <= 10)
          SELECT rank, doc_id, window_no, source, relevance FROM z QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) <= 4""",
        "source_relevance": f"{_PASSAGES}, own AS (SELECT DISTINCT source AS url FROM documents) SELECT url, round(coalesce((SELECT max(relevance) FROM p WHERE p.source = own.url), 0), 6) AS relevance FROM own",
        "score_source": f"""SELECT page_id, round(least(greatest(0.5::DOUBLE + CASE page_id % 4 WHEN 0 THEN 0.2::DOUBLE WHEN 2 THEN 0 ELSE -0.3::DOUBLE END + CASE WHEN length({_TITLE}) > 3 THEN 0.1::DOUBLE ELSE 0 END, 0), 1), 6) AS score FROM pages""",
        "normalise_url": f"{_NORM} SELECT page_id, normalised FROM n",
        "dedupe_urls": f"{_NORM} SELECT page_id, url FROM n QUALIFY row_number() OVER (PARTITION BY normalised ORDER BY page_id) = 1",
        "url_origin_counts": f"{_NORM} SELECT origin, count(*) AS n FROM n GROUP BY origin",
        "url_depth": f"{_NORM} SELECT page_id, CAST(len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS INTEGER) AS depth FROM n",
        "url_score": f"{_SCORE} SELECT page_id, score FROM s",
        "recency_score": "SELECT o_orderkey, round(exp(-(epoch_us(TIMESTAMP '2026-01-01') - epoch_us(date_trunc('day', o_orderdate))) / 86400e6::DOUBLE / 365.0::DOUBLE), 6) AS score FROM orders",
        "page_title": f"SELECT page_id, nullif({_TITLE}, '') AS title FROM pages",
        "page_links": f"SELECT page_id, pos, href, anchor_text FROM ({_ANCHORS})",
        "same_origin_links": f"{_LINKS} SELECT page_id, link, anchor_text FROM l",
        "anchor_overlap": f"""WITH a AS ({_ANCHORS}), q AS (SELECT list_distinct({_tokens(_Q)}) AS asked)
          SELECT page_id, pos, round(len(list_intersect(list_distinct({_tokens('anchor_text')}), asked)) / CAST(len(asked) AS DOUBLE), 6) AS overlap FROM a, q""",
        "candidate_rank": f"{_SCORE} SELECT origin, CAST(row_number() OVER (PARTITION BY origin ORDER BY score DESC, page_id) AS INTEGER) AS rank, page_id, score FROM s QUALIFY rank <= 5",
        "stop_prefix": """WITH v AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank, CAST(doc_id % 3 = 0 AS BIGINT) AS good FROM documents),
          b AS (SELECT *, CAST(coalesce(sum(good) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS good_before FROM v)
          SELECT source, doc_id, rank, good_before FROM b WHERE good_before < 8""",
        "budget_cut": "SELECT source, doc_id, CAST(sum(doc_id % 3 + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM documents QUALIFY used <= 16",
        "url_repair": _values("query_id, url, resolved, method, resolved_url, reason", [
            (1, "https://a.com/docs/install", True, "exact", "https://a.com/docs/install", None),
            (2, "https://a.com/docs/install/?utm_source=x", True, "normalised", "https://a.com/docs/install", None),
            (3, "https://a.com/moved", True, "canonical", "https://a.com/docs/config", None),
            (4, "https://a.com/docs/authentication-guide", True, "path_similarity", "https://a.com/docs/auth-guide", None),
            (5, "https://a.com/zzz", False, "none", None, "no_safe_url_match"),
            (6, "https://b.com/docs/install", False, "none", None, "no_safe_url_match"),
        ]),
        "path_similarity": f"""{_LINKS}, t AS (SELECT page_id, link, path AS a, href AS b, list_distinct({_RTOK.format('path')}) AS x, list_distinct({_RTOK.format('href')}) AS y FROM l)
          SELECT page_id, link, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1 WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE least(1, len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE)
             + len(list_filter(x, lambda r: len(list_filter(y, lambda c: r <> c AND (starts_with(r, c) OR starts_with(c, r)) AND least(length(r), length(c)) >= 4)) > 0)) / CAST(greatest(len(x), len(y)) AS DOUBLE) * 0.4::DOUBLE
             + CASE WHEN regexp_replace(a, '/[^/]*$', '') = regexp_replace(b, '/[^/]*$', '') THEN 0.1::DOUBLE ELSE 0 END
             + CASE WHEN a LIKE '%.%' AND b LIKE '%.%' AND string_split(a, '.')[-1] <> '' AND lower(string_split(a, '.')[-1]) = lower(string_split(b, '.')[-1]) THEN 0.05::DOUBLE ELSE 0 END) END, 6) AS similarity FROM t""",
        "infer_mode": f"SELECT conv_id, turn, {_MODE} AS mode FROM (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT -query_id, 0, query FROM {_QUERIES})",
        "resolve_budget": f"""SELECT query_id, mode, CASE WHEN query_id = 2 THEN 9 ELSE CASE mode WHEN 'fast' THEN 2 WHEN 'balanced' THEN 6 ELSE 12 END END AS max_pages, CASE mode WHEN 'fast' THEN 4 WHEN 'balanced' THEN 8 ELSE 16 END AS max_internal_requests
          FROM (SELECT query_id, {_MODE} AS mode FROM {_QUERIES})""",
        "expand_tokens": f"""WITH s(key, words) AS (VALUES {', '.join("('" + k + "', '" + ' '.join(w) + "')" for k, w in SYNONYMS.items())}),
          t AS (SELECT query_id, unnest({_tokens('query')}) AS token FROM {_QUERIES})
          SELECT query_id, token FROM t UNION SELECT query_id, unnest({_tokens('words')}) FROM t JOIN s ON s.key = t.token""",
        "robots_groups": _values("origin, group_no, agents, n_rules, crawl_delay", [("https://a.com", 0, "*", 2, 2.0), ("https://a.com", 1, "gleanery,other", 2, None), ("https://b.com", 0, "*", 3, None), ("https://e.com", 0, "*", 1, None), ("https://f.com", 0, "*", 2, None)]).replace("2.0", "CAST(2.0 AS DOUBLE)"),
        "robots_allowed": _values("url, allowed", [
            ("https://a.com/private/x", True), ("https://a.com/tmp/1", False), ("https://a.com/doc.pdf", False), ("https://a.com/doc.pdf?x=1", True), ("https://b.com/same/1", True), ("https://b.com/q?a=1", False), ("https://b.com/qa", True),
            ("https://c.com/any", True), ("https://d.com/any", False), ("https://e.com/any", True), ("https://f.com/early", False), ("https://f.com/x/1/y/2", False), ("https://f.com/x/y", True), ("https://unknown.com/z", True),
        ]),
        "ssrf_ipv4": _values("id, ssrf_blocked", [(1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, True), (8, False), (9, True), (10, False), (11, False), (12, False), (13, False), (14, True)]),
        "ssrf_ipv6": _values("ip, blocked", [(ip, ip not in ("fec0::1", "2001:4860:4860::8888", "100:0:0:1::1", "::ffff:808:808")) for ip in X.IPV6]),
        "safe_port": _values("port, safe", [(p, p in (80, 443, 8080, 8443)) for p in X.PORTS]),
        "url_error": _values("id, error", [(i, {11: "UNSAFE_PORT", 12: "UNSAFE_SCHEME", 13: "INVALID_URL"}.get(i)) for i, _ in X.URLS]),
        "domain_policy": f"""SELECT page_id FROM (SELECT page_id, {_HOST} AS host FROM pages) WHERE regexp_matches(host, '(^|\\.)example\\.(com|org)$') AND NOT regexp_matches(host, '(^|\\.)spam-farm\\.example\\.org$|(^|\\.)www\\.cheap-pills\\.example\\.com$')""",
        "redirect_chain": _values("url, final_url, hops, error", [
            ("http://a.com/1", "http://b.com/3", 2, None), ("http://loop.com/x", "http://loop.com/y", 1, "LOOP"), ("http://long.com/0", "http://long.com/5", 5, "TOO_MANY_REDIRECTS"), ("http://long.com/1", "http://long.com/6", 5, None),
            ("http://private.com/", "http://private.com/", 0, "SSRF_BLOCKED"), ("http://scheme.com/", "http://scheme.com/", 0, "UNSAFE_SCHEME"), ("http://none.com/", "http://none.com/", 0, None),
        ]),
        "retry_delay": _values("id, delay_ms", [(1, 30000), (2, 30000), (3, 1000), (4, 4000), (5, 30000), (6, 10000), (7, 0), (8, 2000)]).replace("SELECT *", "SELECT id, CAST(delay_ms AS BIGINT) AS delay_ms"),
        "mime_detect": _values("id, mime", [
            (1, "text/html"), (2, "application/xml"), (3, "application/pdf"), (4, "image/jpeg"), (5, "application/json"), (6, "image/png"), (7, "image/jpeg"), (8, "text/plain"), (9, "unknown"), (10, "application/atom+xml"), (11, "image/webp"),
            (12, "application/javascript"), (13, "text/html"), (14, "application/rss+xml"),
        ]),
        "json_flatten": "SELECT event_id, k AS path, json_extract_string(props, '$.\"' || k || '\"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events) WHERE value IS NOT NULL",
        "json_paths": "SELECT event_id, string_agg('[' || k || '] ' || json_extract_string(props, '$.\"' || k || '\"'), chr(10) ORDER BY n) AS text FROM (SELECT event_id, props, unnest(json_keys(props)) AS k, unnest(generate_series(1, len(json_keys(props)))) AS n FROM events) GROUP BY event_id",
        "bare_url_links": "SELECT page_id, url AS link FROM pages",
        "strip_tags": r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM pages",
        "sitemap_entries": _values("url, loc, lastmod, priority", [("https://a.com/one.xml", "https://a.com/guide", "2025-06-01", 0.8), ("https://a.com/one.xml", "https://a.com/zero", None, None), ("https://a.com/two.txt", "https://a.com/text", None, None), ("https://a.com/two.txt", "http://a.com/plain", None, None)]).replace("0.8", "CAST(0.8 AS DOUBLE)"),
        "sitemap_discovery": _values("origin, url, pos", [("https://a.com", "https://a.com/guide", 1), ("https://a.com", "https://a.com/zero", 2), ("https://a.com", "https://a.com/text", 3), ("https://a.com", "http://a.com/plain", 4)]),
        "feed_items": _values("url, pos, title, date, summary, link", [
            ("https://a.com/rss", 0, "One", "Mon, 01 Jan 2024 00:00:00 GMT", "Bold text", "https://a.com/1"), ("https://a.com/rss", 1, "Two", None, None, "https://a.com/2"), ("https://a.com/atom", 0, "Only", "2024-02-03", "Body", "https://a.com/3"),
        ]),
        "best_call_result": """SELECT conv_id AS tool_call_id, turn AS pos, status FROM (SELECT *, CASE WHEN (conv_id + turn) % 5 = 0 THEN 'success' ELSE 'not_found' END AS status FROM conversations)
          QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY status = 'success' DESC, CASE WHEN status = 'success' THEN turn END NULLS LAST, turn % 3 DESC, turn) = 1""",
        "cached_fetches": """WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS k, epoch_us(ts) AS t, event_id % 5 <> 0 AND event_id % 7 * 400000 <= 2097152 AS c FROM events),
          s(k, t, id) AS (SELECT k, min((t, id))[1], min((t, id))[2] FROM e WHERE c GROUP BY k
            UNION ALL SELECT s.k, min((e.t, e.id))[1], min((e.t, e.id))[2] FROM s JOIN e ON e.k = s.k AND e.c AND e.t > s.t + 86400000000 GROUP BY s.k)
          SELECT id AS request_id, EXISTS (SELECT 1 FROM s WHERE s.k = e.k AND (s.t, s.id) < (e.t, e.id) AND e.t <= s.t + 86400000000) AS hit FROM e""",
        "answer_message": f"""{_ANSWERS} SELECT query_id, concat_ws(chr(10), 'Status: ' || status, 'Sources fetched: ' || n, 'Evidence passages: ' || n,
            CASE WHEN resolved AND resolved_url <> url THEN 'URL repaired: ' || url || ' → ' || resolved_url END,
            CASE WHEN n = 0 THEN 'No relevant evidence found.' || CASE WHEN resolved THEN '' ELSE chr(10) || 'URL could not be resolved: ' || coalesce(reason, 'unknown') END
                 ELSE chr(10) || list_aggregate(list_transform(generate_series(1, n), lambda i: 'Source: ' || url || '/' || i || chr(10) || 'Section: Part' || chr(10) || body || chr(10)), 'string_agg', chr(10)) END) AS text FROM a""",
        "answer_function": f"""{_ANSWERS} SELECT query_id, CAST(to_json(struct_pack(status := status, query := {_Q}, evidenceCount := n,
            navigation := json_merge_patch('{{}}', to_json(struct_pack(resolved := resolved, method := CASE WHEN resolved THEN 'exact' ELSE 'none' END, resolvedUrl := resolved_url, reason := reason))),
            evidence := list_transform(generate_series(1, least(n, 5)), lambda i: struct_pack(sourceUrl := url || '/' || i, text := body, section := 'Part', relevance := i / 8.0::DOUBLE)))) AS VARCHAR) AS json FROM a""",
        "answer_rpc": f"""{_ANSWERS} SELECT query_id, CAST(to_json(struct_pack(jsonrpc := '2.0', id := query_id, result := struct_pack(content := [struct_pack(type := 'text', text := CAST(to_json(struct_pack(status := status, query := {_Q})) AS VARCHAR))]))) AS VARCHAR) AS json FROM a""",
        "cache_ttl": "SELECT user_id AS key, max(ts) AS stored_at FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 30 DAY > (SELECT max(ts) FROM events)",
        "host_gap": """SELECT event_id AS request_id, CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000) AS BIGINT) AS gap_ms, coalesce(CAST(trunc((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000) AS BIGINT) < 500, false) AS too_soon
          FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)""",
    }
    return out
