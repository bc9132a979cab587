"""HTML extraction (F27, S6, P30): metadata by expressions, text by an Arrow UDF on the standard library's HTML parser.

The rule is our own: the first ``<article>``, else ``<main>``, else ``<body>``; navigation, headers, footers, asides, forms,
scripts and styles are left out; block elements separate paragraphs.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import trim_space
from ..functions.policy import js_required
from ..functions.urls import canonical_url

_SKIPPED = {"script", "style", "nav", "footer", "aside", "header", "form", "noscript", "svg", "iframe", "template"}
_BLOCKS = {"p", "div", "section", "article", "main", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "tr", "br", "hr", "figure"}
_MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "##### ", "h6": "###### ", "li": "- ", "blockquote": "> "}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.inside: list[str] = []
        self.parts: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.marked: dict[str, list[str]] = {"article": [], "main": [], "body": []}
        self.title: list[str] = []
        self.in_title = False

    def _put(self, text: str, marked: str) -> None:
        for root in self.parts:
            if root == "body" or root in self.inside:
                self.parts[root].append(text)
                self.marked[root].append(marked)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag in _SKIPPED:
            self.skip += 1
        if tag in ("article", "main"):
            self.inside.append(tag)
        if tag in _BLOCKS and not self.skip:
            self._put("\n\n", "\n\n" + _MARKS.get(tag, ""))

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if tag in _SKIPPED:
            self.skip = max(0, self.skip - 1)
        if tag in _BLOCKS and tag not in _VOID and not self.skip:
            self._put("\n\n", "\n\n")
        if tag in ("article", "main") and tag in self.inside:
            self.inside.remove(tag)

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self._put(data, data)


def _paragraphs(parts: list[str]) -> str:
    blocks = (" ".join(b.split()) for b in "".join(parts).split("\n\n"))
    return "\n\n".join(b for b in blocks if b and b not in ("#", "##", "-", ">"))


def extract_page(html: str | None) -> dict[str, str]:
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    root = next((r for r in ("article", "main", "body") if _paragraphs(reader.parts[r])), "body")
    return {"title": " ".join("".join(reader.title).split()), "main_text": _paragraphs(reader.parts[root]), "markdown": _paragraphs(reader.marked[root])}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "main_text", "markdown")]))
def extract(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract_page(h) for h in html], columns=["title", "main_text", "markdown"])


def raw_title(html: Column) -> Column:
    """The first title element's text as written, trimmed."""
    return trim_space(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"""(?is)<meta[^>]+(?:name|property)=["']{name}["'][^>]+content=["']([^"']*)["']""", 1)


def language(html: Column) -> Column:
    return F.regexp_extract(html, r"""(?is)<html[^>]*\blang=["']([^"']*)["']""", 1)


def parse_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with their canonical URL and content (title, main_text, markdown, author, description, language, unsupported_reason)."""
    h = F.col(html)
    rows = pages.withColumn("_e", extract(html))
    reason = F.when(trim_space(F.coalesce(h, F.lit(""))) == "", "extract_failed").when(js_required(h, F.col("_e.main_text")), "js_required").otherwise("")
    content = F.struct(
        F.col(url).alias("url"), F.col("_e.title").alias("title"), meta(h, "author").alias("author"), meta(h, "og:site_name").alias("site_name"), meta(h, "description").alias("description"),
        language(h).alias("language"), F.col("_e.main_text").alias("main_text"), F.col("_e.markdown").alias("markdown"), F.lit("").alias("cleaned_html"), reason.alias("unsupported_reason"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )
    return rows.select(*[c for c in pages.columns if c != html], canonical_url(F.col(url)).alias("canonical"), content.alias("content"))
