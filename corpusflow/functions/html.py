"""Page title, visible text and anchors — one Arrow-batched
``pandas_udf`` per page batch, built on the standard library's
``html.parser`` (one parse per page returns all three).

Text rules: the subtrees of the removable tags are dropped; every remaining
text node (comments and the doctype excluded, entities decoded) becomes its
own line; lines are stripped and blank ones dropped.  The title is the text
of the first ``<title>`` when it is a single text node, stripped.  Anchors are
every ``<a href>`` of the whole page (removed sections included), in document
order, resolved against the page URL."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Subtrees dropped before the text is taken.
REMOVABLE_TAGS = {"script", "style", "header", "footer", "nav", "noscript", "svg"}
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
             "source", "track", "wbr"}

PAGE_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("hrefs", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(T.StringType())),
])


class _PageParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.hrefs: list[str] = []
        self.open: list[str] = []          # open elements
        self.removed: list[int] = []       # places in `open` of the removable ones
        self.title_parts: list[str] | None = None
        self.title_done = False
        self.title_children = 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            for k, v in attrs:
                if k == "href" and v is not None:
                    self.hrefs.append(v)
                    break
        if tag in VOID_TAGS:
            if self.title_parts is not None and not self.title_done:
                self.title_children += 1
            return
        self.open.append(tag)
        if tag in REMOVABLE_TAGS:
            self.removed.append(len(self.open) - 1)
            return
        if self.title_parts is not None and not self.title_done:
            self.title_children += 1       # an element inside <title>: .string is None
        if tag == "title" and not self.title_done and self.title_parts is None and not self.removed:
            self.title_parts = []

    def handle_startendtag(self, tag, attrs):
        if tag == "a":
            for k, v in attrs:
                if k == "href" and v is not None:
                    self.hrefs.append(v)
                    break

    def handle_endtag(self, tag):
        # an element ends its unclosed descendants, removable ones too; an end
        # tag without an open element ends nothing
        inside = bool(self.removed)
        if tag in self.open:
            while self.open.pop() != tag:
                pass
            while self.removed and self.removed[-1] >= len(self.open):
                self.removed.pop()
        if inside:
            return
        if tag == "title" and self.title_parts is not None and not self.title_done:
            self.title_done = True

    def handle_data(self, data):
        if self.removed:
            return
        self.nodes.append(data)
        if self.title_parts is not None and not self.title_done:
            self.title_parts.append(data)


def _joined(base: str, href: str) -> str | None:
    """The resolved link; None for one that is no URL, so that a bad anchor
    costs that link only."""
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def parse_page(html: str | None, url: str | None) -> dict:
    if html is None:
        return {"title": None, "text": None, "hrefs": None, "links": None}
    p = _PageParser()
    p.feed(html)
    p.close()
    lines = [ln.strip() for ln in "\n".join(p.nodes).splitlines()]
    text = "\n".join(ln for ln in lines if ln)
    title = ""
    if p.title_parts is not None and len(p.title_parts) == 1 and p.title_children == 0:
        title = p.title_parts[0].strip()
    base = url or ""
    links = [_joined(base, h) for h in p.hrefs]
    return {"title": title, "text": text, "hrefs": p.hrefs, "links": links}


@F.pandas_udf(PAGE_SCHEMA)
def parse_pages(html: pd.Series, url: pd.Series) -> pd.DataFrame:
    out = [parse_page(h, u) for h, u in zip(html, url)]
    return pd.DataFrame(out, columns=["title", "text", "hrefs", "links"])
