"""Text of marked-up pages, as expressions."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that stand on lines of their own.
BLOCKS = (
    "address article aside blockquote br canvas dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol option p pre section select table tbody td tfoot th thead tr ul"
).split()


def text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags; block elements give line breaks, the five
    basic entities are resolved, spaces collapsed, and the ends stripped."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?i)</?[a-z][^>]*>", "")
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", "\""), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n[ \n]*", "\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


_CUT = rf"(?i)</?(?:{'|'.join(BLOCKS)}|body|html|head|title)\b[^>]*>"


def _blocks(html: Column) -> Column:
    """ARRAY<STRUCT<html, n, linked>>: the page's blocks between block elements, with their words and
    the words inside of links; empty ones are left out."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    words = lambda x: F.size(F.filter(F.split(F.regexp_replace(x, r"(?i)</?[a-z][^>]*>", " "), r"\s+"), lambda w: w != ""))
    links = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), F.lit(0), lambda n, a: n + words(a))
    parts = F.transform(F.split(t, _CUT), lambda x: F.struct(x.alias("html"), words(x).alias("n"), links(x).alias("linked")))
    return F.filter(parts, lambda b: b["n"] > 0)


def main_text(html: Column) -> Column:
    """The page's article without menus, link lists and other boilerplate, one block per line.

    A block counts by its own words, those of its neighbours and the shares of linked words, by the
    published decision rules on these shallow features."""
    b = _blocks(html)

    def keep(x: Column, i: Column) -> Column:
        at = lambda k: F.get(b, i + k)
        share = lambda y: F.coalesce(y["linked"] / y["n"], F.lit(0.0))
        words = lambda y: F.coalesce(y["n"], F.lit(0))
        before, after = at(-1), at(1)
        # The thresholds of the rules.
        plain = F.when(words(x) > 16, True).when(words(after) > 15, True).otherwise(words(before) > 4)
        behind_links = F.when(words(x) > 40, True).otherwise(words(after) > 17)
        return (share(x) <= 0.333333) & F.when(share(before) <= 0.555556, plain).otherwise(behind_links)

    return F.array_join(F.transform(F.filter(b, keep), lambda x: text(x["html"])), "\n")


def page_title(html: Column) -> Column:
    """The page's title, null where it has none."""
    t = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    return F.when(t != "", text(t))


def xhtml(html: Column) -> Column:
    """The page's body as markup that a parser of XML can read: elements closed in order, attributes
    dropped, text escaped. Elements that are closed twice or never are closed where their parent is."""
    empty = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "wbr"}

    class Writer(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out: list[str] = []
            self.open: list[str] = []
            self.silent = 0

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.silent += 1
            elif not self.silent:
                self.out.append(f"<{tag}/>" if tag in empty else f"<{tag}>")
                if tag not in empty:
                    self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.silent = max(0, self.silent - 1)
            elif not self.silent and tag in self.open:
                while (last := self.open.pop()) != tag:
                    self.out.append(f"</{last}>")
                self.out.append(f"</{tag}>")

        def handle_data(self, data):
            if not self.silent:
                self.out.append(escape(data, quote=False))

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        w = Writer()
        w.feed(page)
        w.close()
        return "<body>" + "".join(w.out) + "".join(f"</{t}>" for t in reversed(w.open)) + "</body>"

    @F.pandas_udf("string")
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in pages:
            yield p.map(one, na_action=None)

    return run(html)
