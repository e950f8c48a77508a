"""HTML to text, Markdown and references, in Arrow batches over the standard parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

HIDDEN = {"script", "style", "noscript", "template", "head", "svg"}
CHROME = {"nav", "footer", "aside", "form"}
BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "tr", "blockquote", "pre", "figure", "header", "main", "br", "hr", "li"}
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Reader(HTMLParser):
    """Collects Markdown; hidden elements and page chrome are left out."""

    def __init__(self, markdown: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.markdown, self.out, self.skipped = markdown, [], []
        self.links: list[str | None] = []
        self.lists: list[int | None] = []
        self.cells = 0

    def _break(self, count: int = 1) -> None:
        self.out.append("\n" * count)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        fields = dict(attrs)
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.append(tag)
            return
        if tag in HIDDEN or tag in CHROME or "hidden" in fields:
            if tag not in ("br", "hr", "img", "input", "meta", "link"):
                self.skipped.append(tag)
            return
        if re.fullmatch("h[1-6]", tag):
            self._break(2)
            self.out.append("#" * int(tag[1]) + " " if self.markdown else "")
        elif tag == "li":
            self._break()
            depth, number = max(0, len(self.lists) - 1), self.lists[-1] if self.lists else None
            if self.lists and number is not None:
                self.lists[-1] = number + 1
            self.out.append("  " * depth + (f"{number}. " if number is not None else "- ") if self.markdown else "")
        elif tag in BLOCKS:
            self._break(2 if tag in ("p", "table", "blockquote", "pre") else 1)
            if tag in ("ul", "ol"):
                self.lists.append(1 if tag == "ol" else None)
            if tag == "tr":
                self.cells = 0
        elif tag in ("td", "th"):
            self.out.append(" | " if self.cells else "")
            self.cells += 1
        elif tag == "a":
            self.links.append(fields.get("href"))
            self.out.append("[" if self.markdown and fields.get("href") else "")
        elif tag == "img" and self.markdown:
            self.out.append(f"![{fields.get('alt') or ''}]({fields.get('src') or ''})")
        elif tag in ("sup", "sub"):
            self.out.append("^" if tag == "sup" else "_")
        elif tag in MARKS and self.markdown:
            self.out.append(MARKS[tag])

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
            return
        if tag == "a" and self.links:
            target = self.links.pop()
            self.out.append(f"]({target})" if self.markdown and target else "")
        elif tag in MARKS and self.markdown:
            self.out.append(MARKS[tag])
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self._break()
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self._break(2 if tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") else 1)

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.out.append(re.sub(r"\s+", " ", data))

    def text(self) -> str:
        joined = re.sub(r"[ \t]*\n[ \t]*", "\n", "".join(self.out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]{2,}", " ", joined)).strip()


def read_html(html: str | None, markdown: bool) -> str | None:
    if html is None:
        return None
    reader = _Reader(markdown)
    reader.feed(html)
    reader.close()
    return reader.text()


PAGES = 64  # read at a time: of a batch, only these are Python's strings


def read_pages(batch: pa.Array, markdown: bool) -> pa.Array:
    """``read_html`` of an Arrow array of pages, slice by slice."""
    parts = (pa.array([read_html(h, markdown) for h in batch.slice(i, PAGES).to_pylist()], pa.string()) for i in range(0, len(batch), PAGES))
    return pa.concat_arrays([*parts, pa.array([], pa.string())])


def html_text(html: Column, markdown: bool = False) -> Column:
    """The readable text of a page, or its Markdown."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        return read_pages(batch, markdown)

    return run(html)


def links(html: Column) -> Column:
    """Targets of a page's links in order."""
    return F.regexp_extract_all(html, F.lit(r"""<a\s[^>]*?href=["']([^"'>]*)["']"""), F.lit(1))
