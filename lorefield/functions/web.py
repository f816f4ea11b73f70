"""Article text clean-up and page reduction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorefield.functions.arrays import let
from lorefield.functions.text import py_strip

# --- fixed values ---
MIN_BODY_CHARS = 200
TITLE_PROBE_CHARS = 300
DEK_PROBE_CHARS = 500
TRAILING_PATTERN = (
    r"(?ims)^(?:#{1,3}\s*)?(written by|share this article|related articles?|references|see also|external links|"
    r"further reading|notes and references|footnotes|citations)\b.*"
)
FOOTNOTE_PATTERN = r"\s?\[\d{1,3}\]"
NOISE_TAGS = ("script", "style", "nav", "footer", "header", "aside")
METADATA_FIELDS = ("title", "author", "date", "sitename", "description", "categories", "tags")
# The two ways a page is fetched, as stored with it, and the source type each gives.
SCRAPED = "zenrows"
FETCHED = "trafilatura"
SOURCE_TYPES = {SCRAPED: "article_zenrows", FETCHED: "article"}
NOT_FETCHED = "Could not fetch URL: "
NO_ARTICLE = "No article content extracted from: "
NO_VIDEO_ID = "Could not extract a YouTube video ID from: "
# --------------------

ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def cut_trailing(body: Column) -> Column:
    return F.regexp_replace(body, TRAILING_PATTERN, "")


def drop_footnotes(body: Column) -> Column:
    return F.regexp_replace(body, FOOTNOTE_PATTERN, "")


def attach_title(body: Column, title: Column, dek: Column) -> Column:
    """Put the title in front when the start of the body lacks it, and then the dek under the same test."""
    name = py_strip(F.coalesce(title, F.lit("")))
    lead = py_strip(F.coalesce(dek, F.lit("")))
    no_title = (name != "") & ~F.contains(F.substring(body, 1, TITLE_PROBE_CHARS), name)
    no_dek = (lead != "") & ~F.contains(F.substring(body, 1, DEK_PROBE_CHARS), lead)
    head = F.concat(F.lit("# "), name, F.lit("\n\n"), F.when(no_dek, F.concat(lead, F.lit("\n\n"))).otherwise(""))
    return F.when(no_title, F.concat(head, body)).otherwise(body)


def finish_article(body: Column, title: Column, dek: Column) -> Column:
    """Cut the trailing parts from the body first, so that a title such as 'References' cannot erase the page."""
    return let(cut_trailing(body), lambda b: py_strip(drop_footnotes(attach_title(b, title, dek))))


def long_enough(html: Column) -> Column:
    return F.length(py_strip(html)) >= MIN_BODY_CHARS


def page_title(html: Column) -> Column:
    """og:title when there is one, else the title element; null when both are missing."""
    og = meta_content(html, "og:title")
    plain = py_strip(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title\s*>", 1)))
    return F.coalesce(og, F.nullif(plain, F.lit("")))


def meta_content(html: Column, name: str) -> Column:
    pattern = rf"(?is)<meta\s[^>]*(?:property|name)\s*=\s*[\"']{name}[\"'][^>]*?content\s*=\s*\"([^\"]*)\""
    return F.nullif(py_strip(unescape(F.regexp_extract(html, pattern, 1))), F.lit(""))


def unescape(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_noise(html: Column) -> Column:
    """Remove comments and the elements that never hold page text."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in NOISE_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return out


def page_text(html: Column) -> Column:
    """Text of the body without noise elements: one line per text run, blank runs dropped."""
    body = F.regexp_replace(strip_noise(html), r"(?is)^.*?<body\b[^>]*>|</body\s*>.*\z", "")
    runs = F.split(body, r"<[^>]*>")
    clean = F.filter(F.transform(runs, lambda r: py_strip(unescape(r))), lambda r: r != "")
    return F.array_join(clean, "\n")


def source_type(source: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in SOURCE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, F.coalesce(source, F.lit(""))), F.lit("article"))
