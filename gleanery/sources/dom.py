"""One tolerant pass over HTML that lays a page out as a table of elements over its text, and what the extractors select from it.

An element is a row: its tag and attributes, the range of the page's text it covers, the range of rows below it, and which
kinds of elements it stands in. Every extractor is a selection over that table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

# Elements without content, elements that hold raw text, and which open elements a start tag closes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"script", "style", "noscript", "svg", "head"}
BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "dt", "dd", "blockquote", "caption"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head", "link", "script"},
}

CHROME = {"nav", "footer"}
PARTS = BLOCKS | {"figcaption", "dl"}
FEEDS = ("application/rss+xml", "application/atom+xml")
HTTP = ("http://", "https://")
NEXT_DATA = "__NEXT_DATA__"
# Attributes that name a value, and the attributes that hold it, before the element's text.
ANNOTATED = {"itemprop": ("content", "href", "src"), "property": ("content", "href")}

_SPACE = re.compile(r"\s+")
_ASSIGNED = re.compile(r"\b(?:window|self)\.(_{0,2}[A-Z][A-Z0-9_]*)\s*=\s*(?=\{)")

@dataclass(slots=True)
class Element:
    at: int  # its row
    name: str
    attrs: dict[str, str]
    parent: int
    begin: int  # of its text
    hidden: bool  # it stands in, or is, an element without visible text
    chrome: bool  # that, or navigation or footer
    in_block: bool  # a block stands around it
    in_part: bool  # a block, caption or definition list stands around it
    end: int = 0
    last: int = 0  # the last row below it


class Page(HTMLParser):
    """The table of a page's elements in document order. A start tag closes what it implies only as long as that is on top of the stack."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.chunks: list[str] = []
        self.open: list[Element] = []
        self.length = 0
        self.feed(html)
        self.close()
        self._shut(0)
        self.whole = "".join(self.chunks)

    def _shut(self, depth: int) -> None:
        for e in self.open[depth:]:
            e.end, e.last = self.length, len(self.elements) - 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        closed = CLOSES.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        while self.open and self.open[-1].name in closed:
            self._shut(len(self.open) - 1)
        up = self.open[-1] if self.open else Element(-1, "", {}, -1, 0, False, False, False, False)
        hidden = up.hidden or tag in SKIPPED
        chrome = up.chrome or hidden or tag in CHROME
        e = Element(len(self.elements), tag, {k: v or "" for k, v in reversed(attrs)}, up.at, self.length, hidden, chrome, up.in_block or up.name in BLOCKS, up.in_part or up.name in PARTS)
        self.elements.append(e)
        self.open.append(e)
        if tag == "br":
            self.handle_data("\n")
        if tag in VOID:
            self._shut(len(self.open) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        depth = next((d for d in range(len(self.open) - 1, -1, -1) if self.open[d].name == tag), None)
        if depth is not None:
            self._shut(depth)

    def handle_data(self, data):
        self.chunks.append(data)
        self.length += len(data)

    def raw(self, e: Element) -> str:
        return self.whole[e.begin : e.end].strip()

    def text(self, e: Element) -> str:
        return collapse(self.whole[e.begin : e.end])

    def named(self, *names: str, within: Element | None = None) -> list[Element]:
        rows = self.elements if within is None else self.elements[within.at + 1 : within.last + 1]
        return [e for e in rows if e.name in names]


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip()


def blocks(page: Page) -> list[str]:
    """Texts of headings, paragraphs, list items, cells and quotes in order; a block's inner blocks belong to it."""
    texts = (page.text(e) for e in page.elements if e.name in BLOCKS and not e.hidden and not e.in_block)
    return [t for t in texts if t]


def structured(page: Page) -> tuple[str, list[str]]:
    """Text with headings marked, without navigation and footer, definition lists as `term: definition`; and the main headings."""
    parts = [(e, page.text(e)) for e in page.elements if e.name in PARTS and not e.chrome and not e.in_part]
    lines = []
    for e, text in parts:
        if e.name == "dl":
            lines += definitions(page, e)
        elif text:
            lines.append(f"\n## {text}" if e.name in HEADINGS else text)
    return "\n".join(lines), [text for e, text in parts if text and e.name in ("h1", "h2")]


def definitions(page: Page, group: Element) -> list[str]:
    """`term: definition` of a list's own definitions that have a term before them."""
    own = [(e.name, page.text(e)) for e in page.named("dt", "dd", within=group) if e.parent == group.at]
    terms = [next((text for name, text in reversed(own[:i]) if name == "dt"), "") for i in range(len(own))]
    return [f"{term}: {text}" for term, (name, text) in zip(terms, own, strict=True) if name == "dd" and term]


def first_of_each(pairs) -> dict[str, str]:
    """The first pair of each name; pairs without name or value don't count."""
    found: dict[str, str] = {}
    for name, value in pairs:
        if name and value:
            found.setdefault(name, value)
    return found


def _rel(e: Element) -> str:
    return e.attrs.get("rel", "").lower()


def metadata(page: Page) -> tuple[dict[str, str], str | None]:
    """Title, meta tags, manifest and hreflang alternates (the first of a name wins); and the last canonical link."""

    def pair(e: Element) -> tuple[str, str]:
        if e.name == "title":
            return "title", page.raw(e)
        if e.name == "meta":
            return (e.attrs.get("name") or e.attrs.get("property") or "").lower(), e.attrs.get("content", "")
        language = e.attrs.get("hreflang")
        name = f"alternate:hreflang:{language}" if _rel(e) == "alternate" and language else "manifest" if _rel(e) == "manifest" else ""
        return name, e.attrs.get("href", "")

    own = page.named("title", "meta", "link")
    canonical = [e.attrs["href"] for e in own if e.name == "link" and _rel(e) == "canonical" and e.attrs.get("href")]
    return first_of_each(map(pair, own)), canonical[-1] if canonical else None


def links(page: Page) -> list[dict]:
    """Anchors that don't start with #, then feed links: href as written, anchor text or None."""
    anchors = [{"href": e.attrs["href"], "anchor_text": page.text(e) or None, "feed": False} for e in page.named("a") if e.attrs.get("href", "#")[:1] not in ("", "#")]
    feeds = [{"href": e.attrs["href"], "anchor_text": None, "feed": True} for e in page.named("link") if e.attrs.get("href") and _rel(e) == "alternate" and e.attrs.get("type", "").lower() in FEEDS]
    return anchors + feeds


def _parsed(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def assignments(script: str) -> list[tuple[str, object]]:
    """Names in capitals that a script assigns to window or self, and the JSON objects that stand behind the equals signs."""
    found, decoder = [], json.JSONDecoder()
    for m in _ASSIGNED.finditer(script):
        try:
            found.append((m[1], decoder.raw_decode(script, m.end())[0]))
        except (ValueError, RecursionError):
            continue
    return found


def app_data(page: Page) -> dict:
    """JSON state embedded in script elements by key: the element's id, the name it is assigned to, or a running number. The first of a name wins."""
    found: dict = {}
    for e in page.named("script"):
        kind, key = e.attrs.get("type", "").lower(), e.attrs.get("id", "")
        if key == NEXT_DATA or kind == "application/json":
            pairs = [(key or f"json_blob_{len(found)}", _parsed(page.raw(e)))]
        else:
            pairs = assignments(page.raw(e)) if kind in ("", "text/javascript") else []
        for name, value in pairs:
            if value is not None:
                found.setdefault(name, value)
    return found


def leaves(value, deepest: int, widest: int | None = None) -> Iterator[tuple[str, object]]:
    """Path and value of a JSON value's leaves in order, down to depth `deepest`, by the first `widest` items of a list."""
    work = [("", 0, value)]
    while work:
        path, depth, value = work.pop()
        if isinstance(value, dict):
            below = [(f"{path}.{key}" if path else key, item) for key, item in value.items()]
        elif isinstance(value, list):
            below = [(f"{path}[{i}]", item) for i, item in enumerate(value[:widest])]
        else:
            yield path, value
            continue
        if depth < deepest:
            work += [(p, depth + 1, item) for p, item in reversed(below)]


def leaf_texts(blobs: dict, deepest: int = 6, cap: int = 8000) -> str:
    """String leaves of 11 to 1,999 characters; after a blob that passes `cap` characters none follows."""
    text = ""
    for blob in blobs.values():
        if len(text) > cap:
            break
        strings = (x.strip() for _, x in leaves(blob, deepest) if isinstance(x, str))
        text = "\n".join(([text] if text else []) + [x for x in strings if 10 < len(x) < 2000])
    return text


def json_ld(page: Page) -> list[str]:
    """JSON-LD entities as JSON texts; a graph counts as its members."""
    values = [_parsed(page.raw(e)) for e in page.named("script") if e.attrs.get("type", "").lower() == "application/ld+json"]
    graphs = [v["@graph"] if isinstance(v, dict) and "@graph" in v else [v] for v in values if v is not None]
    return [json.dumps(entity, ensure_ascii=False) for graph in graphs if isinstance(graph, list) for entity in graph]


def annotations(page: Page) -> dict[str, str]:
    """Microdata and RDFa values by name, the first of a name winning."""
    pairs = []
    for e in page.elements:
        for attribute, sources in ANNOTATED.items():
            given = [e.attrs[s] for s in sources if s in e.attrs]
            pairs.append((e.attrs.get(attribute), given[0] if given else page.raw(e) if attribute in e.attrs else None))
    return first_of_each(pairs)


def tables(page: Page, limit: int = 10) -> list[dict]:
    """Caption and rows of the first tables that have two rows and two columns at least."""
    out = []
    for table in page.named("table")[:limit]:
        cells = [[page.text(c) for c in page.named("td", "th", within=row)] for row in page.named("tr", within=table)]
        rows = [r for r in cells if r]
        if len(rows) >= 2 and len(rows[0]) >= 2:
            captions = [page.text(c) for c in page.named("caption", within=table)[:1]]
            out.append({"caption": captions[0] if captions and captions[0] else None, "rows": rows})
    return out


def extract(html: str) -> dict:
    """Everything the engine reads from a page, by one pass."""
    page = Page(html)
    found, canonical = metadata(page)
    data = app_data(page)
    text = "\n\n".join(t for t in ("\n".join(blocks(page)), leaf_texts(data)) if t)
    body, sections = structured(page)
    bare = not data and not found.get("og:title") and not found.get("description")
    return {
        "text": text, "title": found.get("title"), "links": links(page), "metadata": list(found.items()), "canonical": canonical,
        "app_data": [(k, json.dumps(v, ensure_ascii=False)) for k, v in data.items()], "json_ld": json_ld(page), "microdata": list(annotations(page).items()),
        "tables": tables(page), "structured": body, "sections": sections, "requires_browser": bare and len(text.strip()) < 100,
    }


def _number(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def json_text(body: str, deepest: int = 12, longest: int = 4000, widest: int = 200) -> tuple[str, list[str]]:
    """`[path] value` lines of a JSON text's leaves, strings of 1 to `longest` characters and no nulls; and the distinct http(s) strings. Empty for malformed texts."""
    rows = list(leaves(_parsed(body), deepest, widest))
    shown = [(path, x if isinstance(x, str) else _number(x)) for path, x in rows if x is not None]
    shown = [f"[{path}] {x}" for path, x in shown if 0 < len(x) <= longest]
    return "\n".join(shown), list(dict.fromkeys(x for _, x in rows if isinstance(x, str) and x.startswith(HTTP)))


def xml_text(body: str) -> tuple[str, list[str]]:
    """All texts of an XML document joined by blanks, and the distinct http(s) values of href, url and loc attributes."""
    page = Page(body)
    targets = [next((e.attrs[k] for k in ("href", "url", "loc") if k in e.attrs), "") for e in page.elements]
    return " ".join(c.strip() for c in page.chunks if c.strip()), list(dict.fromkeys(t for t in targets if t.startswith(HTTP)))
