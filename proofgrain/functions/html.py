"""HTML functions: regular expressions on the JVM where they do, Arrow functions for the rest."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrain.functions.text import filled, strip

HREF = r"""(?is)<a[^>]*\shref=["']([^"']*)["']"""
#: Elements whose text is no content.
SKIPPED = {"script", "style", "noscript"}


def title_of(html: Column) -> Column:
    """The first title element, spaces folded, at most 120 characters."""
    t = F.regexp_extract(filled(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.substring(strip(F.regexp_replace(t, r"\s+", " ")), 1, 120)


def strip_tags(html: Column) -> Column:
    """Text without scripts, styles and tags, spaces squeezed."""
    t = F.regexp_replace(filled(html), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    return squeeze(F.regexp_replace(t, r"(?s)<[^>]+>", ""))


def squeeze(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]+", " ")
    return strip(t)


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(filled(html), F.lit(HREF), F.lit(1))


class _Links(HTMLParser):
    """Links without a hidden element among themselves and four ancestors."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.links, self.open = [], [], None

    @staticmethod
    def _hidden(attrs: dict) -> bool:
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return "hidden" in attrs or "display:none" in style or "visibility:hidden" in style

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag not in ("br", "img", "input", "meta", "link", "hr"):
            self.stack.append((tag, self._hidden(attrs)))
        if tag == "a":
            href = attrs.get("href") or ""
            if href.startswith("http") and not any(h for _, h in self.stack[-5:]) and href not in self.links:
                self.links.append(href)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.parts = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in SKIPPED

    def handle_endtag(self, tag):
        self.skip -= tag in SKIPPED and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.ArrayType(T.StringType()))
def clean_links(html: pd.Series) -> pd.Series:
    """Absolute links of a page that aren't hidden, in order, each once."""
    def one(h):
        p = _Links()
        p.feed(h or "")
        return p.links
    return html.map(one)


@F.pandas_udf(T.StringType())
def main_text(html: pd.Series) -> pd.Series:
    """All text but scripts and styles, a line an element, spaces squeezed; null for null."""
    def one(h):
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        t = re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", "\n".join(p.parts)))
        return t.strip()
    return html.map(one)
