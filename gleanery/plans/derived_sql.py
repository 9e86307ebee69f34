"""DuckDB forms of the queries in derived.py: the same inputs written in SQL, and the results computed from them."""

from __future__ import annotations

from .oracle import _MODE, _NORM, _PARTS, _PATH, _tokens
from .oracle import SYNONYM_ROWS as _SYNONYMS

# Networks that must not be fetched, as first and last address.
_NETS = """(VALUES ('127.0.0.0', '127.255.255.255'), ('10.0.0.0', '10.255.255.255'), ('172.16.0.0', '172.31.255.255'), ('192.168.0.0', '192.168.255.255'), ('169.254.0.0', '169.254.255.255'),
  ('100.64.0.0', '100.127.255.255'), ('192.0.2.0', '192.0.2.255'), ('198.51.100.0', '198.51.100.255'), ('203.0.113.0', '203.0.113.255'), ('0.0.0.0', '0.255.255.255'), ('240.0.0.0', '255.255.255.255')) r(first, last)"""


def _number(ip: str) -> str:
    part = lambda i: f"CAST(split_part({ip}, '.', {i}) AS BIGINT)"
    return f"({part(1)} * 16777216 + {part(2)} * 65536 + {part(3)} * 256 + {part(4)})"


def _ipv4(k: str) -> str:
    return f"[10, 172, 192, 169, 127, 100, 8, 224, 0, 198][{k} % 10 + 1] || '.' || ({k} // 10) % 256 || '.' || ({k} * 7) % 256 || '.' || {k} % 256"


def _pick(k: str, *values: str) -> str:
    return "CASE " + " ".join(f"WHEN {k} % {len(values)} = {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _inside(ip: str) -> str:
    return f"EXISTS (SELECT 1 FROM {_NETS} WHERE {_number(ip)} BETWEEN {_number('first')} AND {_number('last')})"


_BARE = "replace(replace(replace({0}, '&amp;', '&'), '&quot;', '\"'), '&amp', '&')"
_FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
_CLEAN = lambda x: _FLAT.format(_BARE.format(f"regexp_replace(replace({x}, '<br>', ' '), '<[^>]*>', '', 'g')"))
# A paragraph that opens a bold element swallows all paragraphs behind it: the bold one is never closed.
_BLOCKS = f"""WITH a AS (SELECT page_id, html, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
b AS (SELECT *, regexp_extract(article, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_replace(article, '(?s)^.*?</h1>', '') AS body FROM a),
c AS (SELECT *, CASE WHEN contains(body, '<p><b>') THEN instr(body, '<p><b>') ELSE length(body) + 1 END AS cut FROM b),
d AS (SELECT page_id, {_CLEAN('h1')} AS h1, list_transform(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1), lambda x: {_CLEAN('x')}) AS items,
        list_filter(list_transform(list_concat(regexp_extract_all(substr(body, 1, cut - 1), '(?s)<p>(.*?)(?:</p>|<p>|$)', 1), [substr(body, cut)]), lambda x: {_CLEAN('x')}), lambda x: x <> '') AS ps FROM c),
t AS (SELECT page_id, h1, array_to_string(list_concat(list_filter(items, lambda x: x <> ''), [h1], ps), chr(10)) AS text, chr(10) || '## ' || array_to_string(list_concat([h1], ps), chr(10)) AS structured FROM d)"""
_ORIGIN = "lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1))"
_MADE = "CAST(c_custkey // 100 AS BIGINT)"


def derived_sql() -> dict[str, str]:
    return {
        "url_error": f"""WITH v AS (SELECT page_id, {_pick('page_id', 'url', "regexp_replace(url, '^https?', 'ftp')", "regexp_replace(url, '^(https?://[^/?#]*)', '\\1:22')", "regexp_replace(url, '^(https?://[^/?#]*)', '\\1:8443')", "'not a url ' || page_id")} AS u FROM pages)
          SELECT page_id, CASE WHEN NOT regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'INVALID_URL' WHEN NOT regexp_matches(u, '^https?:') THEN 'UNSAFE_SCHEME'
            WHEN regexp_extract(u, '^https?://[^/?#:]*:(\\d+)', 1) NOT IN ('', '80', '443', '8080', '8443') THEN 'UNSAFE_PORT' END AS error FROM v""",
        "safe_port": "SELECT o_orderkey, o_orderkey % 10000 IN (80, 443, 8080, 8443) AS safe FROM orders",
        "ssrf_ipv4": f"""WITH u AS (SELECT o_orderkey AS id, {_ipv4('o_orderkey')} AS ip FROM orders UNION ALL SELECT -1 - c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN {_ipv4('c_custkey')} END FROM customer)
          SELECT id, coalesce({_inside('ip')}, false) AS ssrf_blocked FROM u""",
        "ssrf_ipv6": f"""WITH k AS (SELECT o_orderkey, o_orderkey % 7 AS kind, (o_orderkey * 37) % 65536 AS head, o_orderkey % 65536 AS tail, {_ipv4('o_orderkey')} AS ip FROM orders)
          SELECT o_orderkey, CASE WHEN kind IN (2, 3, 5) THEN true WHEN kind = 4 THEN {_inside('ip')} WHEN kind = 6 THEN false
            ELSE head // 512 = 126 OR head // 64 = 1018 OR head // 256 = 255 OR head = 256 OR (head = 0 AND tail <= 1) END AS blocked FROM k""",
        "robots_allowed": f"""WITH u AS (SELECT page_id, length({_ORIGIN}) % 5 AS t, {_PATH} AS path, regexp_extract(url, '(\\?[^#]*)', 1) AS q FROM pages)
          SELECT page_id, CASE t WHEN 0 THEN NOT starts_with(path, '/en/') OR starts_with(path, '/en/1') WHEN 1 THEN NOT (path || q) LIKE '%.html' WHEN 3 THEN false ELSE true END AS allowed FROM u""",
        "robots_groups": f"""WITH o AS (SELECT DISTINCT {_ORIGIN} AS origin FROM pages)
          SELECT origin, g AS group_no, agents, n_rules, CAST(delay AS DOUBLE) AS crawl_delay FROM o JOIN (VALUES (0, 0, '*', 2, NULL), (1, 0, 'other', 1, NULL), (1, 1, 'gleanery', 1, NULL), (2, 0, '*', 1, 3), (4, 0, '*', 1, NULL)) v(t, g, agents, n_rules, delay) ON length(origin) % 5 = t""",
        "crawl_delay": f"SELECT DISTINCT {_ORIGIN} AS origin, CAST(3 AS DOUBLE) AS crawl_delay FROM pages WHERE length({_ORIGIN}) % 5 = 2",
        "redirect_chain": """WITH h AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey = 0 THEN 0 ELSE length(bin(o_orderkey)) END AS n FROM orders)
          SELECT 'http://h.example/' || k AS url, 'http://h.example/' || CASE WHEN n <= 5 THEN 0 ELSE k // 32 END AS final_url, CAST(least(n, 5) AS INTEGER) AS hops, CASE WHEN n > 5 THEN 'TOO_MANY_REDIRECTS' END AS error FROM h
          UNION ALL SELECT 'http://loop.example/' || k, 'http://loop.example/' || xor(k, 1), 1, 'LOOP' FROM h""",
        "rate_schedule": """WITH RECURSIVE n AS (SELECT event_id, event_type || user_id AS host, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY event_type || user_id ORDER BY ts, event_id) AS i FROM events),
          s AS (SELECT event_id, host, ms, i, ms AS start FROM n WHERE i = 1 UNION ALL SELECT n.event_id, n.host, n.ms, n.i, greatest(n.ms, s.start + 3600000) FROM s JOIN n ON n.host = s.host AND n.i = s.i + 1)
          SELECT event_id AS request_id, CAST(start - ms AS BIGINT) AS wait_ms FROM s""",
        "retry_delay": """SELECT o_orderkey, CAST(least(30000, CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey % 50) * 1000 WHEN 2 THEN greatest(0, epoch(o_orderdate) - epoch(TIMESTAMP '1996-06-01')) * 1000 ELSE 1000 * pow(2, (o_orderkey // 4) % 7) END) AS BIGINT) AS delay_ms FROM orders""",
        "body_limits": "SELECT page_id, CASE WHEN page_id % 4 = 3 OR strlen(html) > 6000 THEN 'RESPONSE_TOO_LARGE' WHEN page_id % 4 = 2 AND strlen(html) > 100 THEN 'COMPRESSION_BOMB' END AS error FROM pages",
        "mime_detect": """WITH v AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'text/plain' WHEN 4 THEN 'image/jpg' END AS h,
            CASE (page_id // 6) % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' WHEN 2 THEN 'application/pdf' WHEN 4 THEN 'application/rss+xml' END AS sniffed FROM pages)
          SELECT page_id, CASE WHEN h = 'text/html' THEN h WHEN h = 'image/jpg' THEN 'image/jpeg' ELSE coalesce(sniffed, h, 'unknown') END AS mime FROM v""",
        "sitemap_entries": f"""SELECT 'https://n' || {_MADE} || '.com/part.xml' AS url, 'https://n' || {_MADE} || '.com/c/' || c_custkey AS loc, CASE WHEN c_custkey % 2 = 0 THEN '2025-01-0' || (c_custkey % 9 + 1) END AS lastmod,
          CAST(nullif('0.' || c_custkey % 10, '0.0') AS DOUBLE) AS priority FROM customer""",
        "sitemap_discovery": f"""SELECT 'https://n' || {_MADE} || '.com' AS origin, 'https://n' || {_MADE} || '.com/c/' || c_custkey AS url, row_number() OVER (PARTITION BY {_MADE} ORDER BY c_custkey) AS pos FROM customer""",
        "find_in_sitemap": f"""WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 4 AS t FROM orders)
          SELECT 'https://N' || k // 100 || '.com/c/' || k || {_pick('t', "''", "'?utm_source=x'", "'/'", "'/more'")} AS url, CASE WHEN t < 3 AND c_custkey IS NOT NULL THEN 'https://n' || k // 100 || '.com/c/' || k END AS entry_url,
            CASE WHEN t < 3 AND c_custkey % 2 = 0 THEN '2025-01-0' || (k % 9 + 1) END AS lastmod, CASE WHEN t < 3 AND c_custkey IS NOT NULL THEN CAST(nullif('0.' || k % 10, '0.0') AS DOUBLE) END AS priority
          FROM a LEFT JOIN customer ON c_custkey = k""",
        "feed_items": """SELECT 'https://s.com/rss/' || s_suppkey // 50 AS url, s_suppkey % 50 AS pos, s_name AS title, CASE WHEN s_suppkey % 2 = 1 THEN 'Mon, 01 Jan 2024 00:00:00 GMT' END AS date, CASE WHEN s_suppkey % 2 = 0 THEN 'No ' || s_suppkey || ' ok' END AS summary, 'https://s.com/' || s_suppkey AS link FROM supplier
          UNION ALL SELECT 'https://s.com/atom/' || s_suppkey // 50, s_suppkey % 50, s_name, '2024-02-0' || (s_suppkey % 9 + 1), 'S' || s_suppkey, 'https://s.com/' || s_suppkey FROM supplier""",
        "url_repair": f"""{_NORM}, f AS (SELECT normalised, arg_min(url, page_id) AS first FROM n GROUP BY 1)
          SELECT page_id AS query_id, page_id % 4 <> 3 AS resolved, {_pick('page_id', "'exact'", "'normalised'", "'canonical'", "'none'")} AS method, {_pick('page_id', 'url', 'first', 'first', 'NULL')} AS resolved_url, CASE WHEN page_id % 4 = 3 THEN 'no_safe_url_match' END AS reason FROM n JOIN f USING (normalised)""",
        "canonical_dedupe": f"""WITH u AS ({_PARTS}), c AS (SELECT DISTINCT url, scheme || '://' || host || regexp_replace(path, '/[0-9]+', '/x') AS canon FROM u WHERE page_id % 3 <> 0), n0 AS ({_NORM} SELECT page_id, normalised FROM n),
          k AS (SELECT p.page_id, CASE WHEN canon IS NULL THEN normalised ELSE regexp_replace(canon, '(.)/$', '\\1') END AS k FROM pages p JOIN n0 USING (page_id) LEFT JOIN c USING (url))
          SELECT min(page_id) AS page_id FROM k GROUP BY k""",
        "query_plan": f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, text AS query FROM conversations WHERE role = 'user'), m AS (SELECT *, {_MODE} AS mode FROM q)
          SELECT query_id, {_pick('query_id', "'https://docs.example.com/'", "'https://a.com/x'", "'unknown'")} AS url, mode, CASE mode WHEN 'fast' THEN 2 WHEN 'balanced' THEN 6 ELSE 12 END AS max_pages,
            CASE WHEN query_id % 2 = 0 THEN 5 ELSE CASE mode WHEN 'fast' THEN 4 WHEN 'balanced' THEN 8 ELSE 16 END END AS max_internal_requests, CASE WHEN query_id % 3 = 2 THEN 'INVALID_URL' END AS error FROM m""",
        "expand_tokens": f"""WITH s(key, words) AS ({_SYNONYMS}), q AS (SELECT conv_id, turn, concat_ws(' ', text, {_pick('conv_id', "'login error'", "'install config'", "'price list'", "'fast docs'")}) AS query FROM conversations WHERE role = 'user'),
          t AS (SELECT conv_id, turn, unnest({_tokens('query')}) AS token FROM q)
          SELECT conv_id, turn, token FROM t UNION SELECT conv_id, turn, unnest({_tokens('words')}) FROM t JOIN s ON s.key = t.token""",
        "token_set": f"SELECT item_id, array_to_string(list_sort(list_distinct({_tokens('text')})), ' ') AS tokens FROM benchmark",
        "resolve_budget": f"""SELECT conv_id, turn, CASE WHEN turn = 2 THEN 9 ELSE CASE mode WHEN 'fast' THEN 2 WHEN 'balanced' THEN 6 ELSE 12 END END AS max_pages, CASE mode WHEN 'fast' THEN 4 WHEN 'balanced' THEN 8 ELSE 16 END AS max_internal_requests
          FROM (SELECT conv_id, turn, {_MODE} AS mode FROM (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'))""",
        "html_structural": f"{_BLOCKS} SELECT page_id, text, structured, h1 AS sections FROM t",
        "html_links": r"""SELECT page_id, pos - 1 AS pos, hrefs[pos] AS href, inners[pos] AS anchor_text FROM (SELECT page_id, hrefs, inners, unnest(generate_series(1, len(hrefs))) AS pos
          FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS hrefs, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS inners FROM pages)) WHERE hrefs[pos] NOT LIKE '#%'""",
        "html_metadata": f"""SELECT page_id, trim({_BARE.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, NULL AS description, NULL AS og_title, NULL AS fr, NULL AS canonical FROM pages
          UNION ALL SELECT -1 - c_custkey, c_name, c_mktsegment, 'O' || c_custkey, '/fr', 'https://c.com/c/' || c_custkey || '?x=1' FROM customer""",
        "html_tables": """SELECT p_partkey, 0 AS pos, 'B ' || p_brand AS caption, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_partkey || ' | ' || p_name || ' |' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '| size | ' || p_size || ' |' ELSE '' END AS markdown FROM part""",
        "structured_data": """WITH e AS (SELECT *, '{"@type": "Product", "name": "' || p_name || '", "size": ' || p_size || '}' AS e FROM part)
          SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN e || chr(10) || '{"n": 1}' WHEN p_partkey % 3 = 0 THEN '' ELSE e END AS json_ld, p_brand AS brand, '/p/' || p_partkey AS page, p_type AS kind FROM e""",
        "app_state": f"""WITH s AS (SELECT event_id, '{{"kind": "' || event_type || '", "event": ' || props || ', "note": "event number ' || event_id || ' of user ' || user_id || '", "deep": [["' || event_type || ' happened again"]]}}' AS state, event_type, user_id FROM events)
          SELECT event_id, 1 AS n, {_pick('event_id', "'__NEXT_DATA__'", "'__STATE__'", "'json_blob_0'")} AS key, state AS value, json_extract_string(state, '$.note') || chr(10) || json_extract_string(state, '$.deep[0][0]') AS text, false AS requires_browser FROM s""",
        "spa_shell": f"""{_BLOCKS} SELECT page_id, length(trim(text)) < 100 AS requires_browser FROM t UNION ALL SELECT -1 - c_custkey, c_custkey % 4 IN (0, 2) AND c_custkey % 7 <> 0 AND (c_custkey % 30) * 6 - 1 < 100 FROM customer""",
        "json_document": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE concat_ws(chr(10), '[order.key] ' || o_orderkey, '[order.price] ' || CASE WHEN o_totalprice = trunc(o_totalprice) THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) ELSE CAST(o_totalprice AS VARCHAR) END,
            '[order.tags[0]] ' || o_orderpriority, '[order.tags[2]] true', '[order.url] https://o.com/' || o_orderkey % 10, '[status] ' || o_orderstatus) END AS text, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'https://o.com/' || o_orderkey % 10 END AS links FROM orders""",
        "xml_text": "SELECT p_partkey, p_name || ' ' || p_size AS text, 'https://p.com/' || p_partkey || ' http://q.com/' AS links FROM part",
        "paged_text": r"""WITH p AS (SELECT doc_id, text, unnest(generate_series(1, least(100, greatest(1, CAST(ceil(length(text) / 500.0) AS BIGINT))))) AS n FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
          s AS (SELECT doc_id, n, regexp_replace(substr(text, (n - 1) * 500 + 1, 500), '^\s+|\s+$', '', 'g') AS t FROM p)
          SELECT doc_id, coalesce(string_agg('[Page ' || n || '] ' || t, chr(10) || chr(10) ORDER BY n) FILTER (t <> ''), '') AS text, count(*) FILTER (t <> '') = 0 AS requires_ocr FROM s GROUP BY doc_id""",
    }
