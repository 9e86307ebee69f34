"""Format readers: HTML, JSON, XML, feeds, sitemaps, text, paged documents; and routing by content type."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U
from ..functions.mime import detect
from ..functions.text import bare_links, collapse, let, plain_text, strip, strip_tags
from . import dom
from .schemas import EXTRACTED, HTML

MAX_SITEMAP_ENTRIES, MAX_CHILDREN, MAX_DEPTH = 10_000, 5, 2

# Paths where sitemaps usually are.
WELL_KNOWN = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.txt"]


def _arrow_type(ddl: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_type(_parse_datatype_string(ddl))


def _mapper(ddl: str, made: Callable[[str], dict]):
    """mapInArrow function: appends a struct `made(text)` of type `ddl` to the other columns; the text comes last."""

    kind = _arrow_type(ddl)

    def run(batches):
        for batch in batches:
            out = [made(t) if t is not None else None for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "extracted"])

    return run


def _extracted(df: DataFrame, column: str, ddl: str, made: Callable[[str], dict]) -> DataFrame:
    """`df` with `column` replaced by the struct `extracted`: one Python pass in Arrow batches."""
    keep = [c for c in df.columns if c != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields), f"extracted struct<{_struct(ddl)}>"])
    return df.select(*keep, column).mapInArrow(_mapper(f"struct<{_struct(ddl)}>", made), schema)


def _struct(ddl: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl).simpleString()[len("struct<") : -1]


def extract_html(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` with struct `extracted` (schemas.HTML) in place of the html; null html gives a null struct."""
    return _extracted(pages, html_col, HTML, dom.extract)


def page_title(html: Column) -> Column:
    """The first non-empty title by pattern, in generated code; entities stay as written."""
    titles = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<title[^>]*>(.*?)</title>"), F.lit(1)), strip)
    return F.get(F.filter(titles, lambda t: t != ""), 0)


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, pos, href, anchor_text of every anchor by pattern (no DOM): the fast path for regular markup."""
    anchor = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"[^>]*>(.*?)</a>'
    found = pages.select(id_col, url_col, F.posexplode(F.arrays_zip(F.regexp_extract_all(html_col, F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all(html_col, F.lit(anchor), F.lit(2)).alias("inner"))).alias("pos", "a"))
    return found.select(id_col, url_col, "pos", F.col("a.href").alias("href"), collapse(F.regexp_replace("a.inner", "<[^>]*>", "")).alias("anchor_text")).where((F.col("href") != "") & ~F.startswith("href", F.lit("#")))


def same_origin_links(links: DataFrame, id_col: str = "page_id", url_col: str = "url", normalised: bool = False) -> DataFrame:
    """First link of each page to each resolved (or normalised) URL of the page's own origin."""
    target = U.resolve(F.col("href"), F.col(url_col))
    target = U.normalise(target) if normalised else target
    rows = links.withColumn("link", target).where(F.col("link").isNotNull() & (U.origin(F.col("link")) == U.origin(F.col(url_col))))
    first = F.row_number().over(W.partitionBy(id_col, "link").orderBy("pos"))
    return rows.withColumn("__f", first).where("__f = 1").drop("__f")


def page_metadata(meta: Column) -> Column:
    """The known keys of a metadata map as a struct, with hreflang alternates as a map."""
    # Key in the map, field in the struct.
    names = [
        ("title", "title"), ("description", "description"), ("canonical", "canonical"), ("og:title", "og_title"), ("og:description", "og_description"), ("og:type", "og_type"),
        ("og:url", "og_url"), ("og:image", "og_image"), ("twitter:title", "twitter_title"), ("twitter:description", "twitter_description"), ("manifest", "manifest"),
    ]
    prefix = "alternate:hreflang:"
    alternates = F.transform_keys(F.map_filter(meta, lambda k, _: F.startswith(k, F.lit(prefix))), lambda k, _: F.substring(k, len(prefix) + 1, 1000))
    return F.struct(*[F.try_element_at(meta, F.lit(key)).alias(name) for key, name in names], F.when(F.size(alternates) > 0, alternates).alias("alternates"), meta.alias("raw"))


def table_markdown(rows: Column) -> Column:
    """A table's rows as Markdown; the first is the header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    header = F.get(rows, 0)
    rule = F.transform(header, lambda _: F.lit("---"))
    return F.array_join(F.concat(F.array(line(header), line(rule)), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def extract_json(docs: DataFrame, body_col: str = "body") -> DataFrame:
    """`docs` with extracted struct<text, links>: `[path] value` lines of a JSON document of any depth; empty for malformed ones."""

    def made(body: str) -> dict:
        text, links = dom.json_text(body)
        return {"text": text, "links": links}

    return _extracted(docs, body_col, "text string, links array<string>", made)


def flat_json_rows(docs: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """id, path, value of a flat JSON object's scalars, in generated code: the fast path for one level."""
    fields = F.from_json(body_col, "map<string,string>")
    return docs.select(id_col, F.explode(fields).alias("path", "value")).where("value IS NOT NULL")


def extract_xml(docs: DataFrame, body_col: str = "body") -> DataFrame:
    """`docs` with extracted struct<text, links> of generic XML."""

    def made(body: str) -> dict:
        text, links = dom.xml_text(body)
        return {"text": text, "links": links}

    return _extracted(docs, body_col, "text string, links array<string>", made)


def xml_kind(body: Column) -> Column:
    """rss, atom, sitemap, sitemap_index or xml by the root element."""
    root = F.lower(F.regexp_extract(F.regexp_replace(body, r"(?s)<\?.*?\?>|<!--.*?-->|<![^>]*>", ""), r"<([A-Za-z][\w:.-]*)", 1))
    return F.when(root == "rss", "rss").when(root == "feed", "atom").when(root == "urlset", "sitemap").when(root == "sitemapindex", "sitemap_index").otherwise("xml")


def feed_items(feeds: DataFrame, id_col: str = "url", body_col: str = "body") -> DataFrame:
    """url, pos, title, date, summary, link of RSS items and Atom entries; a child that is missing is null, and a single item is a list of one."""
    rss = F.from_xml(F.col(body_col), "channel struct<title:string,item:array<struct<title:string,link:string,description:string,pubDate:string>>>")
    atom = F.from_xml(F.col(body_col), "title string, entry array<struct<title:string,link:array<struct<_href:string>>,updated:string,summary:string,content:string>>")
    kind = xml_kind(F.col(body_col))
    empty = lambda c: F.nullif(strip(c), F.lit(""))
    one = feeds.where(kind == "rss").select(id_col, F.posexplode(rss["channel"]["item"]).alias("pos", "i")).select(id_col, "pos", empty(F.col("i.title")).alias("title"), empty(F.col("i.pubDate")).alias("date"), strip_tags(empty(F.col("i.description"))).alias("summary"), empty(F.col("i.link")).alias("link"))
    two = feeds.where(kind == "atom").select(id_col, F.posexplode(atom["entry"]).alias("pos", "i")).select(id_col, "pos", empty(F.col("i.title")).alias("title"), empty(F.col("i.updated")).alias("date"), strip_tags(F.coalesce(empty(F.col("i.summary")), empty(F.col("i.content")))).alias("summary"), F.get("i.link", 0)["_href"].alias("link"))
    return one.unionByName(two)


def feed_text(items: DataFrame, id_col: str = "url", published: str = "Published: ") -> DataFrame:
    """url, text, links: items as heading, date and summary lines, a blank line between items."""
    item = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.concat(F.lit(published), F.col("date")), "summary")
    rows = items.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("t"), "link"))).alias("rows"))
    return rows.select(id_col, F.array_join(F.col("rows.t"), "\n\n").alias("text"), F.filter("rows.link", lambda x: x.isNotNull()).alias("links"))


def sitemap_entries(files: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """url, pos, loc, lastmod, changefreq, priority of urlset and plain-text sitemaps; locations must start with http; priority 0 is none."""
    body = F.regexp_replace(body_col, r"^\s+", "")
    listed = F.from_xml(body, "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>")
    xml = files.where(xml_kind(body) == "sitemap").select(url_col, F.posexplode(listed["url"]).alias("pos", "e"))
    xml = xml.select(url_col, "pos", strip(F.col("e.loc")).alias("loc"), F.nullif(strip(F.col("e.lastmod")), F.lit("")).alias("lastmod"), F.nullif(strip(F.col("e.changefreq")), F.lit("")).alias("changefreq"), F.nullif(strip(F.col("e.priority")).try_cast("double"), F.lit(0.0)).alias("priority"))
    null = F.lit(None).cast("string")
    text = files.where(~F.startswith(body, F.lit("<"))).select(url_col, F.posexplode(F.split(body_col, r"\r?\n")).alias("pos", "line"))
    text = text.select(url_col, "pos", strip(F.col("line")).alias("loc"), null.alias("lastmod"), null.alias("changefreq"), F.lit(None).cast("double").alias("priority"))
    return xml.unionByName(text).where(F.startswith("loc", F.lit("http")))


def sitemap_children(files: DataFrame, url_col: str = "url", body_col: str = "body") -> DataFrame:
    """url, pos, child: the first MAX_CHILDREN sitemaps an index lists."""
    body = F.regexp_replace(body_col, r"^\s+", "")
    listed = F.from_xml(body, "sitemap array<struct<loc:string>>")
    rows = files.where(xml_kind(body) == "sitemap_index").select(url_col, F.posexplode(listed["sitemap"]).alias("pos", "e"))
    return rows.select(url_col, "pos", strip(F.col("e.loc")).alias("child")).where((F.col("pos") < MAX_CHILDREN) & F.startswith("child", F.lit("http")))


def discover_sitemaps(origins: DataFrame, declared: DataFrame, files: DataFrame) -> DataFrame:
    """origin, url, lastmod, changefreq, priority, pos: entries of each origin's declared sitemaps, or else the well-known ones.

    Indexes are followed MAX_DEPTH levels, by that many equi-joins; a file counts once per origin; MAX_SITEMAP_ENTRIES per origin.
    """
    known = origins.select("origin", F.explode(F.array(*[F.lit(p) for p in WELL_KNOWN])).alias("p")).select("origin", F.concat("origin", "p").alias("url"))
    known = known.join(declared.select("origin").distinct(), "origin", "left_anti")
    level = declared.select("origin", "url").unionByName(known)
    children = sitemap_children(files)
    reached = level
    for _ in range(MAX_DEPTH):
        level = level.join(children.select("url", "child"), "url").select("origin", F.col("child").alias("url"))
        reached = reached.unionByName(level)
    entries = sitemap_entries(files)
    rows = reached.distinct().join(entries.withColumnRenamed("url", "sitemap"), F.col("url") == F.col("sitemap")).select("origin", "sitemap", "pos", F.col("loc").alias("url"), "lastmod", "changefreq", "priority")
    rank = F.row_number().over(W.partitionBy("origin").orderBy("sitemap", "pos"))
    return rows.withColumn("pos", rank).where(F.col("pos") <= MAX_SITEMAP_ENTRIES)


def paged_text(pages: DataFrame, id_col: str = "doc_id", page_col: str = "page_no", text_col: str = "page_text", limit: int = 100) -> DataFrame:
    """doc_id, text, requires_ocr from a table of page texts (of PDFs, say): `[Page n] text` by blank lines; OCR where no page has text."""
    rows = pages.where(F.col(page_col) <= limit).groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col(page_col).alias("n"), strip(F.coalesce(F.col(text_col), F.lit(""))).alias("t")))).alias("p"))
    shown = F.transform(F.filter("p", lambda x: x["t"] != ""), lambda x: F.concat(F.lit("[Page "), x["n"].cast("string"), F.lit("] "), x["t"]))
    return rows.select(id_col, F.array_join(shown, "\n\n").alias("text"), (F.size(shown) == 0).alias("requires_ocr"))


def extract_text(body: Column) -> Column:
    """struct<text, links> of plain text or Markdown."""
    text = plain_text(body)
    return F.struct(text.alias("text"), bare_links(text).alias("links"))



def extract_documents(fetched: DataFrame, url_col: str = "url", extra: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """`fetched` (url, mime, body_text) with struct `extracted` (schemas.EXTRACTED), routed by content type.

    `extra` maps content types to functions of (url, body_text) frames that return (url, extracted) frames; they come first.
    Each type's rows are filtered before its parser, and the parts united; types without a reader give a null struct.
    """
    extra = extra or {}
    rows = fetched.select(url_col, "mime", "body_text")
    taken = list(extra)
    kind = f"struct<{_struct(EXTRACTED)}>"
    parts = [extra[m](rows.where(F.col("mime") == m).select(url_col, "body_text")).select(url_col, F.col("extracted").cast(kind).alias("extracted")) for m in taken]
    rest = rows.where(~F.col("mime").isin(taken)) if taken else rows
    html = extract_html(rest.where("mime = 'text/html'").select(url_col, F.col("body_text").alias("html")))
    e = F.col("extracted")
    links = F.transform(e["links"], lambda x: F.struct(U.resolve(x["href"], F.col(url_col)).alias("url"), x["anchor_text"].alias("anchor_text"), x["feed"].alias("feed")))
    own = let(U.origin(F.col(url_col)), lambda site: F.filter(links, lambda x: x["url"].isNotNull() & (x["feed"] | (U.origin(x["url"]) == site))))
    own = F.transform(own, lambda x: F.struct(x["url"].alias("url"), x["anchor_text"].alias("anchor_text")))
    meta = F.when(e["canonical"].isNotNull(), F.map_concat(F.map_filter(e["metadata"], lambda k, _: k != "canonical"), F.create_map(F.lit("canonical"), F.coalesce(U.resolve(e["canonical"], F.col(url_col)), e["canonical"])))).otherwise(e["metadata"])
    parts.append(html.select(url_col, F.struct(e["text"].alias("text"), e["title"].alias("title"), own.alias("links"), meta.alias("metadata"), e["requires_browser"].alias("requires_browser"), F.lit(False).alias("requires_ocr")).cast(kind).alias("extracted")))

    def simple(found: DataFrame) -> DataFrame:
        e = F.col("extracted")
        links = F.transform(e["links"], lambda x: F.struct(x.alias("url"), F.lit(None).cast("string").alias("anchor_text")))
        return found.select(url_col, F.struct(e["text"].alias("text"), F.lit(None).cast("string").alias("title"), links.alias("links"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(False).alias("requires_browser"), F.lit(False).alias("requires_ocr")).cast(kind).alias("extracted"))

    parts.append(simple(extract_json(rest.where("mime = 'application/json'").select(url_col, F.col("body_text").alias("body")))))
    xml = rest.where(F.col("mime").isin("application/xml", "application/rss+xml", "application/atom+xml")).select(url_col, F.col("body_text").alias("body"))
    feeds = xml.where(xml_kind(F.col("body")).isin("rss", "atom"))
    parts.append(simple(feed_text(feed_items(feeds, url_col), url_col).select(url_col, F.struct("text", "links").alias("extracted"))))
    parts.append(simple(extract_xml(xml.where(~xml_kind(F.col("body")).isin("rss", "atom")))))
    text = rest.where(F.col("mime").isin("text/plain", "text/markdown", "text/csv"))
    parts.append(simple(text.select(url_col, extract_text(F.col("body_text")).alias("extracted"))))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return fetched.join(found, url_col, "left")


def with_mime(fetched: DataFrame) -> DataFrame:
    """`fetched` (url, status, headers, body) with mime and, decoded from UTF-8, body_text."""
    return fetched.withColumn("mime", detect(F.try_element_at("headers", F.lit("content-type")), F.col("body"))).withColumn("body_text", F.decode("body", "UTF-8"))
