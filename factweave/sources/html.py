"""Raw HTML to nested, typed relations in one Python stage; everything after it is Catalyst's.

A small tree builder on the standard library's tokenizer knows void elements, raw text and the
end tags that HTML lets authors leave out.  One pass over the tree emits flat events in
document order; headings' context is carried along.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# fixed values: what HTML itself says about elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {
    "li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
SCOPES = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
# fixed values: elements, and class or id words, that hold no content
NOISE_TAGS = frozenset(("script", "style", "nav", "header", "footer", "aside"))
NOISE_WORDS = frozenset((
    "nav", "navbar", "menu", "footer", "header", "sidebar", "cookie", "breadcrumb", "social-share", "site-footer", "site-header", "skip-link",
    "announcement-bar", "back-to-top",
))
HEADINGS = ("h1", "h2", "h3", "h4")
CTA = re.compile(r"\b(apply|enrol|enroll|register|sign\s*up|get\s*started|book|buy|download|enquire|inquire|contact)\b", re.IGNORECASE)
_SPACE = re.compile(r"[\t\n\x0b\f\r    -     　﻿]+")


def squash(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


@dataclass(eq=False)
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: tuple[str, ...] = ()) -> str:
        """All text below, with a space wherever an element begins or ends within words."""
        out: list[str] = []
        todo: list[Node | str] = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in skip:
                out.append(" ")
                todo.append(" ")
                todo.extend(reversed(c.children))
        return squash("".join(out))

    def has(self, *tags: str) -> bool:
        node = self.parent
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    @property
    def noisy(self) -> bool:
        if self.tag in NOISE_TAGS:
            return True
        words = f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}".split()
        return not NOISE_WORDS.isdisjoint(words)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str], scope: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in scope:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES[tag])
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "button"})
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def build(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_NUMBERS = re.compile(r"\d[\d,.]*")
_UNITS = re.compile(r"\b(inr|usd|eur|gbp|rs|lakhs?|lacs?|crores?|years?|months?|semesters?|weeks?|days?|hours?|hrs?|per|annum|credits?)\b", re.IGNORECASE | re.ASCII)


def value_shaped(text: str) -> bool:
    return bool(text) and not re.search("[A-Za-z]{3,}", _UNITS.sub(" ", _NUMBERS.sub(" ", text)))


def absolute(base: str, ref: str | None) -> str | None:
    if not ref:
        return None
    try:
        url = urljoin(base, ref.strip())
        return url if urlsplit(url).scheme in ("http", "https") and urlsplit(url).hostname else None
    except ValueError:
        return None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


def _table(node: Node) -> tuple[list[str], list[list[str]]]:
    headers: list[str] = []
    rows: list[list[str]] = []
    for tr in (n for n in node.walk() if n.tag == "tr"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")]
        texts = [c.text() for c in cells]
        if any(c.tag == "th" for c in cells):
            headers += texts
        elif any(texts):
            rows.append(texts)
    return headers, rows


LAZY = ("data-lazy-src", "data-src", "data-original")


def _image(node: Node, base: str) -> str | None:
    for name in LAZY:
        if node.attrs.get(name):
            return absolute(base, node.attrs[name])
    if node.attrs.get("srcset"):
        return absolute(base, node.attrs["srcset"].split(",")[0].split()[0])
    return absolute(base, node.attrs.get("src"))


def parse(html: str, url: str) -> dict:
    """One page as a nested record."""
    root = build(html)
    page: dict = {"title": None, "meta_description": None, "open_graph": {}, "json_ld": [], "links": [], "headings": [], "blocks": [], "tables": [], "images": [], "logos": []}
    footers = []
    for node in root.walk():
        a = node.attrs
        if node.tag == "title" and page["title"] is None:
            page["title"] = node.text() or None
        elif node.tag == "meta":
            if a.get("name", "").lower() == "description" and page["meta_description"] is None:
                page["meta_description"] = squash(a.get("content", "")) or None
            if a.get("property", "").startswith("og:"):
                page["open_graph"].setdefault(a["property"], a.get("content", ""))
        elif node.tag == "script" and a.get("type") == "application/ld+json":
            try:
                data = json.loads("".join(c for c in node.children if isinstance(c, str)))
                page["json_ld"] += [json.dumps(x, sort_keys=True) for x in (data if isinstance(data, list) else [data])]
            except ValueError:
                pass
        elif node.tag == "a" and "href" in a:
            target = absolute(url, a["href"])
            if target:
                text = node.text() or None
                kind = "navigation" if node.has("nav", "header", "footer") else "unknown" if not text else "cta" if CTA.search(text) else "content"
                page["links"].append({"idx": len(page["links"]), "url": target, "text": text, "relation": "internal" if _host(target) == _host(url) else "external", "link_type": kind})
        elif node.tag == "footer":
            footers.append(node.text())
        elif node.tag == "img" and node.has("header", "nav"):
            source = _image(node, url)
            if source:
                hinted = any("logo" in a.get(k, "").lower() for k in ("class", "id", "alt"))
                page["logos"].append({"idx": len(page["logos"]), "url": source, "alt": a.get("alt") or None, "hinted": hinted})
    page["footer_text"] = squash(" ".join(footers)) or None
    _content(root, url, page)
    return page


def _content(root: Node, url: str, page: dict) -> None:
    """Headings, blocks, tables and images outside noise, in one walk."""
    heading: str | None = None
    struck = ("del", "s", "strike")

    def block(tag: str, text: str, cut: bool = False) -> None:
        page["blocks"].append({"idx": len(page["blocks"]), "tag": tag, "heading_context": heading, "text": text, "struck": cut})

    todo = [root]
    while todo:
        node = todo.pop()
        if node.noisy:
            continue
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
        tag = node.tag
        if tag in HEADINGS:
            full = node.text()
            if full:
                page["headings"].append({"idx": len(page["headings"]), "level": int(tag[1]), "text": full})
            text = node.text(struck)
            if text and value_shaped(text):
                block(tag, text)
            elif text:
                heading = text
        elif tag in struck:
            if node.text():
                block(tag, node.text(), True)
        elif tag == "table":
            headers, rows = _table(node)
            if headers or rows:
                page["tables"].append({"idx": len(page["tables"]), "heading_context": heading, "headers": headers, "rows": rows})
        elif tag == "select":
            for option in (n for n in node.walk() if n.tag == "option"):
                if option.attrs.get("value", "").strip() and option.text():
                    block("option", option.text())
        elif tag == "img":
            source = absolute(url, node.attrs.get("src") or node.attrs.get("data-lazy-src") or node.attrs.get("data-src"))
            if source:
                page["images"].append({"idx": len(page["images"]), "heading_context": heading, "url": source, "alt": squash(node.attrs.get("alt", "")) or None})
        elif tag in ("p", "li"):
            text = node.text(struck)
            if text:
                block(tag, text)
        elif tag in ("div", "span") and not node.has("table", *HEADINGS):
            inner = [c for c in node.children if isinstance(c, Node) and c.tag not in ("svg", "img")]
            text = squash(" ".join(c for c in node.children if isinstance(c, str))) if inner else node.text()
            if text:
                block(tag, text)


PAGE_SCHEMA = """title string, meta_description string, open_graph map<string,string>, json_ld array<string>,
 links array<struct<idx:int,url:string,text:string,relation:string,link_type:string>>,
 headings array<struct<idx:int,level:int,text:string>>,
 blocks array<struct<idx:int,tag:string,heading_context:string,text:string,struck:boolean>>,
 tables array<struct<idx:int,heading_context:string,headers:array<string>,rows:array<array<string>>>>,
 images array<struct<idx:int,heading_context:string,url:string,alt:string>>,
 logos array<struct<idx:int,url:string,alt:string,hinted:boolean>>, footer_text string, ok boolean, error string"""


def parse_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page parsed: id, url and the columns of ``PAGE_SCHEMA``.  A page that can't be read
    has ``ok`` false and the error, and never fails the stage."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    own: StructType = pages.select(id_col, url_col).schema
    schema = StructType(own.fields + _parse_datatype_string(PAGE_SCHEMA).fields)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema.fields[2:]]

    def run(batches):
        for batch in batches:
            rows = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    rows.append(parse(html or "", url or "") | {"ok": True, "error": None})
                except Exception as e:  # noqa: BLE001  a broken page is a row, not a failure
                    rows.append({"ok": False, "error": f"{type(e).__name__}: {e}"})
            made = [pa.array([list(r.get(n, {}).items()) if n == "open_graph" else r.get(n) for r in rows], arrow.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], schema=arrow)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
