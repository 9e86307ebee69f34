"""Explicit schemas of the engine's tables; nothing is inferred."""

REQUESTS = "query_id long, pos int, url string, query string, mode string, max_pages int, max_internal_requests int, as_of timestamp"
FETCHED = "url string, status int, headers map<string,string>, body binary"
ROBOTS = "origin string, status int, text string"
DNS = "host string, address string"
REDIRECTS = "from_url string, to_url string"
OBSERVED = "url string, pos int, source string, anchor_text string, lastmod string, priority double"
EXTRACTED = "text string, title string, links array<struct<url:string,anchor_text:string>>, metadata map<string,string>, requires_browser boolean, requires_ocr boolean"
HTML = (
    "text string, title string, links array<struct<href:string,anchor_text:string,feed:boolean>>, metadata map<string,string>, canonical string, "
    "app_data map<string,string>, json_ld array<string>, microdata map<string,string>, tables array<struct<caption:string,rows:array<array<string>>>>, "
    "structured string, sections array<string>, requires_browser boolean"
)
