"""DuckDB forms of the queries in signals.py."""

from __future__ import annotations

from .derived_sql import _pick
from .oracle import _HOST, _PATH, _Q, _TITLE, _tokens

_BASE = "https://www.spam-farm.example.org/"
_ASKED = f"""SELECT conv_id, turn, concat_ws(' ', array_to_string(string_split(text, ' ')[:3], ' '), {_pick('conv_id', "'latest api release?'", "'research paper on this'", "'price table'", "'how does it work?'", "'announcement'")}) AS query FROM conversations WHERE role = 'user'"""


def _any(words: str) -> str:
    return f"regexp_matches(lower(coalesce(query, '')), '(^|[^a-z0-9])({words})([^a-z0-9]|$)')"


_FRESH = f"CASE WHEN {_any('latest|current|today|now|news|price')} THEN 'high' WHEN {_any('recent|version|release|update|updated')} THEN 'medium' ELSE 'low' END"
_TECHNICAL = _any("api|error|specification|documentation|install|config|middleware|sdk")
_FILLERS = "'how,does,do,did,what,is,are,the,a,an,why,when,where,which,who,can,to,of,in,on,for,work,works'"
_ADDRESS = f"replace({_HOST}, '.', ' ') || ' ' || translate({_PATH}, '/-_.', '    ')"
_BODY = r"regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_START = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"


def _base_score(url: str) -> str:
    """The URL score of the query `ASKED` against the base, as in the query url_score."""
    host, path = f"lower(regexp_extract({url}, '^[A-Za-z]+://([^/?#:]*)', 1))", f"CASE WHEN regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({url}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END"
    words = f"replace({host}, '.', ' ') || ' ' || translate({path}, '/-_.', '    ')"
    asked = f"list_distinct({_tokens(chr(39) + 'english thing 825 example' + chr(39))})"
    return f"""round(least(1.0::DOUBLE, len(list_filter({_tokens(words)}, lambda t: list_contains({asked}, t))) / CAST(len({asked}) AS DOUBLE) * 0.4::DOUBLE
      + greatest(0.0::DOUBLE, 1.0::DOUBLE - len(list_filter(string_split({path}, '/'), lambda x: x <> '')) * 0.1::DOUBLE) * 0.1::DOUBLE + 0.7::DOUBLE * 0.1::DOUBLE + 0.5::DOUBLE * 0.05::DOUBLE
      + CASE WHEN lower({url}) LIKE 'https://www.spam-farm.example.org/%' THEN 0.1::DOUBLE ELSE 0 END), 6)"""


_SITE = "CASE WHEN list_contains(['co.uk','org.uk','ac.uk','gov.uk','com.au','org.au','co.jp','co.nz','com.br','co.in','com.bd'], array_to_string(string_split({h}, '.')[-2:], '.')) THEN array_to_string(string_split({h}, '.')[-3:], '.') ELSE array_to_string(string_split({h}, '.')[-2:], '.') END"
_RESOURCES = [("link", "href", "'/i' || p_partkey || '.ico'"), ("a", "href", "'/a' || p_partkey"), ("img", "src", "'/m' || p_partkey || '.png'"), ("form", "action", "'/f'"), ("iframe", "src", "'/fr'"), ("script", "src", "'/s.js'")]


def _resource_rows() -> str:
    own = [f"SELECT -1 - p_partkey AS page_id, '{tag}' AS kind, 0 AS pos, {href} AS href FROM part" + (" WHERE p_partkey % 2 = 0" if tag in ("iframe", "script") else "") for tag, _, href in _RESOURCES]
    links = """SELECT page_id, 'a' AS kind, pos - 1 AS pos, hrefs[pos] AS href FROM (SELECT page_id, hrefs, unnest(generate_series(1, len(hrefs))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)) WHERE hrefs[pos] <> ''"""
    return " UNION ALL ".join([*own, links])


def signals_sql() -> dict[str, str]:
    fields = [("coalesce(title, '')", "3.0::DOUBLE"), ("address", "1.5::DOUBLE"), ("body", "1.0::DOUBLE")]
    rows = " UNION ALL ".join(f"SELECT page_id, unnest({_tokens(x)}) AS term, {w} AS w FROM p" for x, w in fields)
    spaced = lambda x: f"' ' || array_to_string({_tokens(x)}, ' ') || ' '"
    return {
        "query_intent": f"""SELECT conv_id, turn, {_FRESH} AS freshness, {_TECHNICAL} AS technical, {_any('paper|research|study|journal|exam')} AS scholarly, {_any('news|announcement|today|release')} AS news_like,
            {_any('pdf|report|paper|specification|documentation')} AS document_like, {_any('price|table|dataset|csv|json|statistics')} AS structured_data_like FROM ({_ASKED})""",
        "query_variants": f"""WITH a AS (SELECT *, regexp_replace(trim(regexp_replace(query, '\\s+', ' ', 'g')), '[?.! ]+$', '') AS asked FROM ({_ASKED})),
          c AS (SELECT *, array_to_string(list_filter(string_split(asked, ' '), lambda w: NOT list_contains(string_split({_FILLERS}, ','), lower(w))), ' ') AS content FROM a),
          f AS (SELECT conv_id, turn, 1 AS k, asked AS v FROM c UNION ALL SELECT conv_id, turn, 2, content FROM c WHERE turn <> 2
            UNION ALL SELECT conv_id, turn, 3, content || ' documentation' FROM c WHERE turn <> 2 AND content <> '' AND {_TECHNICAL} AND NOT contains(lower(content), 'documentation')
            UNION ALL SELECT conv_id, turn, 4, 'latest ' || content FROM c WHERE turn <> 2 AND content <> '' AND {_FRESH} <> 'low' AND NOT contains(lower(content), 'latest'))
          SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k) - 1 AS pos, v AS variant FROM (SELECT conv_id, turn, v, min(k) AS k FROM f WHERE v <> '' GROUP BY ALL)""",
        "field_bm25": f"""WITH p AS (SELECT page_id, nullif({_TITLE}, '') AS title, {_ADDRESS} AS address, {_BODY} AS body FROM pages), t AS ({rows}),
          l AS (SELECT page_id, coalesce(sum(w), 0) AS n FROM p LEFT JOIN t USING (page_id) GROUP BY page_id), c AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(n) AS mean FROM l),
          asked(query_id, query) AS (VALUES (1, {_Q}), (2, 'english thing 825 example')), q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens('query')}) AS term FROM asked) GROUP BY ALL),
          h AS (SELECT page_id, term, sum(w) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM h GROUP BY term),
          r AS (SELECT query_id, page_id, sum(qtf * ln((total - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))) AS raw
            FROM h JOIN f USING (term) JOIN q USING (term) JOIN l USING (page_id), c GROUP BY ALL)
          SELECT query_id, page_id, round(raw / max(raw) OVER (PARTITION BY query_id), 6) AS score, {' OR '.join(f"contains({spaced(x)}, {spaced('query')})" for x, _ in fields)} AS phrase FROM r JOIN asked USING (query_id) JOIN p USING (page_id)""",
        "candidate_score": f"""WITH u AS (SELECT page_id, {_TITLE} AS title, {_base_score('url')} AS score, {_pick('page_id', 'url', 'url', f"{_START} || '/about/us'")} AS url FROM pages),
          n AS (SELECT *, lower({_START}) AS o, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path, list_sort(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS ps FROM u),
          k AS (SELECT *, row_number() OVER (PARTITION BY o, CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE '/' END, ps ORDER BY page_id) > 1 AS later, list_distinct({_tokens(_Q)}) AS asked FROM n)
          SELECT page_id, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, score + len(list_intersect(list_distinct({_tokens('title')}), asked)) / CAST(len(asked) AS DOUBLE) * 0.2::DOUBLE
            - CASE WHEN regexp_matches(lower(path), '(^|[/.])(about|contact|privacy|terms|cookies|login|signup|careers|legal|imprint)([/.]|$)') THEN 0.15::DOUBLE ELSE 0 END - CASE WHEN later THEN 0.3::DOUBLE ELSE 0 END)), 6) AS score FROM k""",
        "diverse_sites": f"""WITH s AS (SELECT page_id, page_id % 7 AS query_id, {_base_score('url')} AS score, {_SITE.format(h=_HOST)} AS site FROM pages),
          k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, site ORDER BY score DESC, page_id) <= 3)
          SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS INTEGER) AS rank, page_id, score FROM k QUALIFY rank <= 10""",
        "site_relation": f"""WITH u AS (SELECT page_id, {_pick('page_id', 'url', "'https://m.spam-farm.example.org/' || page_id", "'https://cdn.a.co.uk/' || page_id", f"'{_BASE}' || page_id", "'mailto:x@y.z'")} AS url FROM pages), h AS (SELECT page_id, url, {_HOST} AS host FROM u), s AS (SELECT *, {_SITE.format(h='host')} AS site FROM h)
          SELECT page_id, CASE WHEN host = '' THEN '' ELSE site END AS site, CASE WHEN host = '' THEN NULL WHEN lower(url) LIKE 'https://www.spam-farm.example.org/%' THEN 'same_origin' WHEN site = 'example.org' THEN 'same_site' WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 'allowed' ELSE 'external' END AS relation FROM s""",
        "evidence_agreement": """WITH c AS (SELECT o_custkey, o_orderpriority AS source, CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus WHEN o_custkey % 6 <> 0 THEN 'x' END AS value FROM orders),
          g AS (SELECT o_custkey, count(DISTINCT source) FILTER (value IS NOT NULL) AS n_sources, count(DISTINCT value) AS n_values FROM c GROUP BY o_custkey)
          SELECT *, CASE WHEN n_values = 0 THEN 'none' WHEN n_values > 1 THEN 'mixed' WHEN n_sources > 1 THEN 'agreed' ELSE 'single' END AS agreement FROM g""",
        "freshness": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 AND o_orderkey % 2 = 1 THEN NULL ELSE CAST(epoch(CASE WHEN o_orderkey % 5 IN (2, 4) THEN o_orderdate ELSE date_trunc('day', o_orderdate) END) AS BIGINT) END AS at,
          {_pick('o_orderkey', "'article_modified'", "'article_published'", "'feed'", "'sitemap'", "CASE WHEN o_orderkey % 2 = 0 THEN 'last_modified' END")} AS signal FROM orders""",
        "provenance": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS INTEGER) END AS page, {_pick('(o_orderkey // 3)', "'order.tags[' || o_orderkey % 9 || ']'", 'NULL', "'status'")} AS json_path, CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS title FROM orders""",
        "index_directives": """SELECT page_id, page_id % 4 IN (1, 2) OR (page_id // 4) % 3 = 2 AS noindex, page_id % 4 IN (1, 2) AS nofollow, page_id % 4 = 3 AS noarchive, (page_id // 4) % 3 = 1 AS nosnippet FROM pages""",
        "skip_reason": f"SELECT page_id, {_pick('page_id', 'NULL', chr(39) + 'action' + chr(39), chr(39) + 'asset' + chr(39), chr(39) + 'action' + chr(39), chr(39) + 'tracker' + chr(39), 'NULL')} AS reason FROM pages",
        "resource_links": _resource_rows(),
        "status_action": f"""SELECT o_orderkey, {_pick('o_orderkey', "'parse'", "'empty'", "'redirect'", "'use_cache'", "'blocked'", "'resolve'", "'retry'", "'backoff'", "'temporary_failure'", "'failure'", "'failure'")} AS action FROM orders""",
        "site_index": f"""WITH made AS (SELECT c_custkey AS k, '<html lang=EN><head><title>' || c_name || '</title><meta name=''description'' content='' about  ' || c_custkey || '''><link rel=''canonical'' href=''/c/' || c_custkey || '''></head><h1>One</h1><p>x</p><h2> <i>Two</i> ' || c_custkey || '</h2><h3></h3></html>' AS html, c_name FROM customer)
          SELECT page_id, url, url AS canonical, nullif({_TITLE}, '') AS title, NULL AS description, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS headings, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS language, sha256(html) AS content_hash FROM pages
          UNION ALL SELECT -1 - k, 'https://c.com/page/' || k, 'https://c.com/c/' || k, c_name, 'about ' || k, 'One' || chr(10) || 'Two ' || k, 'en', sha256(html) FROM made""",
        "evaluation": """WITH c AS (SELECT o_orderpriority, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 2 END AS e, nullif((o_orderkey // 2) % 3, 2) AS r FROM orders)
          SELECT o_orderpriority, count(*) AS n_cases, round(count(*) FILTER (e = r) / CAST(nullif(count(e), 0) AS DOUBLE), 6) AS url_recall, round(count(*) FILTER (e = r) / CAST(nullif(count(r), 0) AS DOUBLE), 6) AS source_precision,
            round(count(*) FILTER (r = 1 AND e = 1) / CAST(nullif(count(*) FILTER (r = 1), 0) AS DOUBLE), 6) AS correction_accuracy, round(count(*) FILTER (r = 1 AND e IS DISTINCT FROM 1) / CAST(nullif(count(*) FILTER (r = 1), 0) AS DOUBLE), 6) AS false_correction_rate
          FROM c GROUP BY o_orderpriority""",
    }
