"""Parts of pages by selector: results of search engines, main text of known sites.

Pages are parsed once in Arrow batches by the standard parser; a selector is a list
of steps (tag, class, part of an attribute; any depth or child), which is all
the tables of selectors need.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrain.functions.html import SKIPPED
from proofgrain.functions.url import SERP_HOSTS

# Where known sites have their main text, marks of redirecting links and of links that are no results.
SITE_SELECTORS = {
    "arxiv.org": "blockquote.abstract, div.abstract",
    "en.wikipedia.org": "div.mw-parser-output",
    "zh.wikipedia.org": "div.mw-parser-output",
    "github.com": "article.entry-content, div.Box-body",
    "stackoverflow.com": "div.s-prose",
    "news.ycombinator.com": "div.comment-tree",
    "pubmed.ncbi.nlm.nih.gov": "div.abstract-content",
    "docs.python.org": "div.body > div.section, div.document",
}
REDIRECTS = ("/link?", "/url?", "/link/", "/url/", "/jump?", "/redirect?", "/ck/")
NO_RESULTS = ("/s?", "/search?", "/web?", "robots.txt", "javascript:", "mailto:", "#")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
STEP = re.compile(r"(?P<tag>[a-zA-Z][\w\-]*)?(?P<classes>(?:\.[\w\-]+)*)(?:\[(?P<key>[\w\-]+)\*=['\"](?P<part>[^'\"]*)['\"]\])?$")


class Element:
    __slots__ = ("tag", "attrs", "parent", "pieces")

    def __init__(self, tag: str, attrs: dict, parent: "Element | None"):
        self.tag, self.attrs, self.parent, self.pieces = tag, attrs, parent, []


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open, self.elements = self.root, []

    def handle_starttag(self, tag, attrs):
        e = Element(tag, dict(attrs), self.open)
        self.open.pieces.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self.open = e

    def handle_endtag(self, tag):
        e = self.open
        while e.parent is not None and e.tag != tag:
            e = e.parent
        if e.parent is not None:
            self.open = e.parent

    def handle_data(self, data):
        if data.strip():
            self.open.pieces.append(data.strip())


def tree(html: str | None) -> _Tree:
    t = _Tree()
    t.feed(html or "")
    return t


def steps(selector: str) -> list[list[tuple[bool, re.Match]]]:
    """The alternatives of a selector; each step says whether it must be a child of the one before."""
    out = []
    for one in selector.split(","):
        path, child = [], False
        for word in one.split():
            if word == ">":
                child = True
            else:
                path.append((child, STEP.match(word)))
                child = False
        out.append(path)
    return out


def _is(e: Element, m: re.Match) -> bool:
    classes = (e.attrs.get("class") or "").split()
    return ((not m["tag"] or e.tag == m["tag"].lower()) and all(c in classes for c in m["classes"].split(".")[1:])
            and (not m["key"] or m["part"] in (e.attrs.get(m["key"]) or "")))


def _under(e: Element, path: list) -> bool:
    child, m = path[-1]
    if not _is(e, m):
        return False
    rest, up = path[:-1], e.parent
    while rest and up is not None and up.parent is not None:
        if _under(up, rest):
            return True
        if child:
            return False
        up = up.parent
    return not rest


def chosen(t: _Tree, selector: str) -> list[Element]:
    paths = steps(selector)
    return [e for e in t.elements if any(_under(e, p) for p in paths)]


def text_of(e: Element) -> list[str]:
    out = []
    for p in e.pieces:
        if isinstance(p, str):
            out.append(p)
        elif p.tag not in SKIPPED:
            out += text_of(p)
    return out


def absolute(href: str | None, base: str) -> str | None:
    """A link that can be followed, or None."""
    h = (href or "").strip()
    if h.startswith("http"):
        return h
    if h.startswith("//"):
        return f"https:{h}"
    host = urlsplit(base or "").netloc
    return f"https://{host}{h}" if h.startswith("/") and host else None


def _results(html: str | None, selector: str | None, base: str | None) -> list[str]:
    t = tree(html)
    links = [u for e in chosen(t, selector) if (u := absolute(e.attrs.get("href"), base))] if selector else []
    if not links:
        own = {*SERP_HOSTS, urlsplit(base or "").netloc.lower()}
        for e in t.elements:
            u = absolute(e.attrs.get("href"), base) if e.tag == "a" else None
            if not u:
                continue
            low = u.lower()
            if urlsplit(u).netloc.lower() in own and not any(r in low for r in REDIRECTS) or any(n in low for n in NO_RESULTS):
                continue
            links.append(u)
    return list(dict.fromkeys(links))


@F.pandas_udf(T.ArrayType(T.StringType()))
def result_links(html: pd.Series, selector: pd.Series, base: pd.Series) -> pd.Series:
    """Links of a result page in order, each once: by the engine's selector, else all that aren't the engine's own."""
    return pd.Series([_results(h, s, b) for h, s, b in zip(html, selector, base)])


@F.pandas_udf(T.StringType())
def _site_text(html: pd.Series, selector: pd.Series) -> pd.Series:
    def one(h, s):
        if not h or not s:
            return None
        parts = [" ".join(text_of(e)) for e in chosen(tree(h), s)]
        return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(p for p in parts if p))).strip() or None
    return pd.Series([one(h, s) for h, s in zip(html, selector)])


def site_text(html: Column, host: Column) -> Column:
    """Main text of a page of a known site, null for others or if its place isn't found."""
    table = F.create_map(*[F.lit(x) for kv in SITE_SELECTORS.items() for x in kv])
    return _site_text(html, F.try_element_at(table, host))
