"""Main content of an HTML page as Markdown: a small rule-based reader used inside an Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.web import NOISE_TAGS

SKIPPED = {*NOISE_TAGS, "noscript", "form", "button", "svg", "iframe", "template"}
BLOCKS = {"p", "div", "section", "article", "main", "ul", "ol", "li", "blockquote", "pre", "table", "tr", "br", "hr", "body"}
HEADINGS = {f"h{n}": "#" * n for n in range(1, 7)}
MARKS = {"b": "**", "strong": "**", "em": "*", "i": "*", "code": "`"}
# A block is dropped as navigation when most of its text sits in links.
LINK_SHARE = 0.5


class _Reader(HTMLParser):
    """Collects Markdown blocks per content root, so the best root can be chosen at the end."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip: list[str] = []
        self.roots: list[str] = []
        self.blocks: list[tuple[bool, str]] = []
        self.text: list[str] = []
        self.open: list[tuple[str, int]] = []
        self.linked = 0
        self.in_link = 0
        self.prefix = ""
        self.row: list[str] | None = None

    def flush(self) -> None:
        while self.open:
            self.close_mark(self.open[-1][0])
        line = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if line and self.linked <= LINK_SHARE * len(line):
            self.blocks.append((bool(self.roots), f"{self.prefix}{line}"))
        self.text, self.linked, self.prefix = [], 0, ""

    def close_mark(self, mark: str) -> None:
        """Write the closing mark, or take the opening one back when nothing came between."""
        opened, at = self.open.pop()
        if opened != mark:
            self.open.append((opened, at))
        elif "".join(self.text[at + 1 :]).strip():
            self.text.append(mark)
        else:
            self.text[at] = ""

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip.append(tag)
        if self.skip:
            return
        if tag in ("td", "th") and self.row is not None:
            self.text, self.open = [], []
        elif tag == "tr":
            self.flush()
            self.row = []
        elif tag in BLOCKS or tag in HEADINGS:
            self.flush()
            if tag in ("article", "main"):
                self.roots.append(tag)
            self.prefix = f"{HEADINGS[tag]} " if tag in HEADINGS else "- " if tag == "li" else "> " if tag == "blockquote" else ""
        elif tag == "a":
            self.in_link += 1
        elif tag in MARKS:
            self.open.append((MARKS[tag], len(self.text)))
            self.text.append(MARKS[tag])
        elif tag == "img":
            given = dict(attrs)
            if given.get("src"):
                self.text.append(f"![{given.get('alt') or ''}]({given['src']})")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("td", "th") and self.row is not None:
            self.row.append(re.sub(r"\s+", " ", "".join(self.text)).strip())
            self.text, self.open = [], []
        elif tag == "tr" and self.row is not None:
            if any(self.row):
                self.blocks.append((bool(self.roots), "| " + " | ".join(self.row) + " |"))
            self.row, self.text, self.open = None, [], []
        elif tag in BLOCKS or tag in HEADINGS:
            self.flush()
            if self.roots and tag == self.roots[-1]:
                self.roots.pop()
        elif tag == "a":
            self.in_link = max(self.in_link - 1, 0)
        elif tag in MARKS and self.open:
            self.close_mark(MARKS[tag])

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.linked += len(data.strip()) if self.in_link else 0


def markdown_of(html: str | None) -> str | None:
    """Markdown of the article or main element, or of the whole body when there is neither; None when empty."""
    if not html:
        return None
    reader = _Reader()
    reader.feed(re.sub(r"(?is)<head\b.*?</head\s*>", "", html))
    reader.close()
    reader.flush()
    chosen = [b for inside, b in reader.blocks if inside] or [b for _, b in reader.blocks]
    return "\n\n".join(chosen).strip() or None


def article_markdown_udf():
    @F.pandas_udf(T.StringType())
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(markdown_of)

    return run
