"""Main text of web pages by deducing the template that the pages of a host share.

Every element path and every word under a path is a token. Tokens with the same occurrence vector over a host's pages
are one equivalence class. A class is valid when enough pages have it and it holds the path of an element or of the page
as a whole; words in the class of the element or page around them are part of the template, and classes nest as their
paths do. What the template leaves are slots. A page's text is the slots of its main
element and articles, without the parts that its markup names as something else.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm import flat
from lorefield.llm.arrow import with_columns
from lorefield.session import checkpointed

LEAST_PAGES = 2
SURE_PAGES = 8
LINK_SHARE = 0.5
LONG_WORDS = 15
SLICE_BYTES = 4 << 20
PAGE = "page"

# Fixed values of the HTML standard: elements without content, with raw content, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = frozenset("br td th option img input".split())
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
# Elements, and words of class, id and role, that mark what is not the article.
OTHER_TAGS = frozenset("head script style noscript template nav aside footer header form iframe object svg select button textarea dialog menu".split())
OTHER_NAMES = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu"
    " breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe"
    " subscription signup login share sharing social related recommended comment comments commentlist disqus respond replies widget toolbar"
    " pagination pager skip hidden".split()
)
# Words that stand beside those names without changing what they say: cookie-bar, site-footer, related-posts.
PLAIN_NAMES = frozenset(
    "site page main top bottom left right center box bar wrap wrapper container inner outer list item items links link block section area slot"
    " buttons button form unit post posts article articles stories entry global primary secondary".split()
)
TEASERS = frozenset("teaser card preview excerpt comment comments reply promo sponsored related recommended".split())
HOLDS_PAGE = frozenset("form header nav".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S)
LOOSE = re.compile(r"<(?:!(?!\[CDATA\[)|\?)")
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A run of text between block borders: its element path, region, words, how many lie in links, and if markup excludes it."""

    path: str
    article: int
    other: bool
    words: list[str] = field(default_factory=list)
    linked: int = 0
    marks: tuple[int, ...] = ()


@dataclass
class _Open:
    tag: str
    path: str
    other: bool
    article: int
    link: bool
    marks: tuple[int, ...] = ()


def _element(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """Name of the element in paths, and whether its tag or attributes, its name, or its name as a teaser say that it is
    not the article. A name says so if it is one of OTHER_NAMES as a whole, or such words and plain ones only."""
    names: list[str] = []
    named = teaser = False
    if attributes:
        for a, b, c in NAMED.findall(attributes):
            for token in (a or b or c).split():
                parts = [w.lower() for w in NAME_PARTS.findall(token)]
                names += parts
                named = named or (not OTHER_NAMES.isdisjoint(parts) and all(w in OTHER_NAMES or w in PLAIN_NAMES for w in parts))
                teaser = teaser or not TEASERS.isdisjoint(parts) and all(w in TEASERS or w in PLAIN_NAMES for w in parts)
    label = f"{tag}.{'.'.join(names)}" if names else tag
    if tag in ("html", "body"):
        return label, False, False, False
    return label, tag in OTHER_TAGS or bool(attributes and HIDDEN.search(attributes)), named, teaser


def _confirmed(blocks: list[Block], mains: set[int]) -> list[Block]:
    """Blocks with `other` set where a name excludes them. An element that holds the page's main element, its only or
    longest article, or most of its words is not excluded by name."""
    sizes: dict[int, int] = {}
    articles: dict[int, int] = {}
    free: set[int] = set()
    for b in blocks:
        if not b.other:
            for mark in b.marks:
                sizes[mark] = sizes.get(mark, 0) + len(b.words)
            if b.article > 0:
                articles[b.article] = articles.get(b.article, 0) + len(b.words)
                if not b.marks:
                    free.add(b.article)
    total = sum(len(b.words) for b in blocks if not b.other)
    kept = {mark for mark, n in sizes.items() if 2 * n > total} | mains
    if articles and not free:
        longest = max(articles, key=lambda a: (articles[a], -a))
        held = [set(b.marks) for b in blocks if b.article == longest and not b.other]
        kept |= set.intersection(*held)
    for b in blocks:
        b.other = b.other or not kept.issuperset(b.marks)
    return blocks


def _untagged(rest: str) -> str:
    """The end of a page that holds no complete tag, up to a comment or declaration that is never closed."""
    cut = LOOSE.search(rest)
    return rest[: cut.start() if cut else None].replace("<![CDATA[", "")


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order. Unclosed, stray and cut-off markup is taken as browsers do: a closing tag closes what
    is open inside it, and a block closes an open paragraph."""
    stack = [_Open("", "", False, 0, False)]
    blocks: list[Block] = []
    texts: list[tuple[str, bool]] = []
    articles, at, marked = 0, 0, 0
    mains: set[int] = set()

    def flush() -> None:
        nonlocal texts
        if not texts:
            return
        joined = "".join([t for t, _ in texts])
        if "&" in joined:
            joined = html.unescape(joined)
        words = joined.split()
        if words:
            top = stack[-1]
            inside = "".join([t for t, link in texts if link])
            linked = len(html.unescape(inside).split()) if inside else 0
            blocks.append(Block(top.path, top.article, top.other, words, linked, top.marks))
        texts = []

    def close(upto: int) -> None:
        if any(o.tag in BLOCK or o.other != stack[upto - 1].other or o.marks != stack[upto - 1].marks for o in stack[upto:]):
            flush()
        del stack[upto:]

    def add(text: str) -> None:
        if text and not (stack[-1].other and stack[-1].tag in RAW):
            texts.append((text, stack[-1].link))

    # Behind the last > no tag is complete: looking for one there would read the rest of the page for every <.
    last = page.rfind(">") + 1
    while at < len(page):
        found = TAG.search(page, at, last) if at < last else None
        if not found:
            add(_untagged(page[at:]))
            break
        add(page[at : found.start()])
        at = found.end()
        if found[0].startswith("<!--") and not found[0][4:].endswith("-->"):
            break
        name = found[2]
        if not name:
            continue
        tag = name.lower()
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            if tag in SPACED:
                add(" ")
            continue
        if tag in CLOSES or tag in BLOCK:
            shut = CLOSES.get(tag, "").split()
            for depth in range(len(stack) - 1, 0, -1):
                open_ = stack[depth].tag
                if open_ in shut or (open_ == "p" and tag in BLOCK):
                    close(depth)
                    break
                if open_ in BLOCK and open_ != "p":
                    break
        if tag in SPACED:
            add(" ")
        label, other, named, teaser = _element(tag, found[3])
        top = stack[-1]
        if tag == "header" or (named and label.partition(".")[2] in ("header", "article.header", "entry.header", "post.header") and tag != "nav"):
            other, named = other and not top.article, named and not top.article
        named = named or (teaser and tag == "article")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        inherited = top.other
        region = top.article
        if tag in ("article", "main") and not other:
            if all(o.tag in HOLDS_PAGE or not o.other or i and stack[i - 1].other for i, o in enumerate(stack)):
                inherited = False
            if tag == "article" and not region > 0:
                articles += 1
                region = articles
            elif tag == "main" and not region:
                region = -1
            if tag == "main":
                mains.update(top.marks)
        if tag in BLOCK or (other and not inherited) or named:
            flush()
        marks = top.marks
        if named and not (inherited or other):
            marked += 1
            marks = (*marks, marked)
        path = f"{top.path}/{label}" if tag in BLOCK else top.path
        stack.append(_Open(tag, path, inherited or other, region, top.link or tag == "a", marks))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            del stack[-1:]
    flush()
    return _confirmed(blocks, mains)


def _hash(text: str) -> int:
    """64-bit hash as a signed number."""
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _role(path: str, word: str = "") -> int:
    return _hash(f"{path}\n{word}" if word else path)


ROLES = "host string, role long, around long, path string, word string, vector long, pages long"
ROLE_NAMES = [f.split(" ")[0] for f in ROLES.split(", ")]


def _roles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial occurrence vectors of the tokens of each host, as exclusive-or of a hash of (page, count).

    Of pages with the same host and content, which come to one task, one counts: copies of a page are no evidence of a
    template. A word whose part already differs from that of the element or page around it cannot be in its class and is left out.
    """
    page = TaskContext.get().partitionId() << 32
    known: set[tuple[str, int]] = set()
    for part in flat.slices(batches, "html", limit=SLICE_BYTES):
        paths: dict[tuple[str, str], tuple[int, int]] = {}
        words: dict[tuple[str, str, str], tuple[int, int]] = {}
        for host, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            content = (host, _hash(text or ""))
            if content in known:
                continue
            known.add(content)
            own = {PAGE: {"": 1}}
            for block in blocks_of(text or ""):
                seen = own.setdefault(block.path, {"": 0})
                seen[""] += 1
                for word in block.words:
                    seen[word] = seen.get(word, 0) + 1
            once = _hash(f"{page} 1")
            for path, seen in own.items():
                count = seen.pop("")
                mark = once if count == 1 else _hash(f"{page} {count}")
                vector, pages = paths.get((host, path), (0, 0))
                paths[host, path] = vector ^ mark, pages + 1
                for word, n in seen.items():
                    if n == count or n == 1:
                        vector, pages = words.get((host, path, word), (0, 0))
                        words[host, path, word] = vector ^ (mark if n == count else once), pages + 1
            page += 1
        rows = [(host, _role(path), None, path, None, *got) for (host, path), got in paths.items()]
        for (host, path, word), got in words.items():
            rows += [(host, _role(path, word), _role(around), path, word, *got) for around in (path, PAGE) if paths[host, around] == got]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ROLE_NAMES)


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, role, vector, pages, words): the elements of valid classes, and the words in the class of each with the path
    they stand under. A word on fewer than SURE_PAGES distinct pages counts only if all pages of its host have it: equal
    vectors come about by chance there.

    Rows of one host with equal `vector` are one class; a class lies inside another when its path does.
    """
    dealt = pages.repartition("host", F.xxhash64("html"))
    tokens = dealt.mapInArrow(_roles, ROLES).groupBy("host", "role", "around").agg(
        F.first("path").alias("path"), F.first("word").alias("word"), F.bit_xor("vector").alias("vector"), F.sum("pages").alias("pages")
    )
    tokens = checkpointed(tokens.where(F.col("pages") >= least_pages))
    elements = tokens.where(F.col("around").isNull()).select("host", "path", "role", "vector", "pages")
    totals = tokens.where(F.col("around").isNull() & (F.col("role") == _role(PAGE))).select("host", F.col("pages").alias("total"))
    sure = (F.col("pages") >= SURE_PAGES) | (F.col("pages") == F.col("total"))
    inner = tokens.where(F.col("around").isNotNull()).join(totals, "host").where(sure).select("host", F.col("around").alias("role"), "vector", "pages", F.struct(F.col("path").alias("under"), "word").alias("word"))
    words = inner.groupBy("host", "role", "vector", "pages").agg(F.collect_list("word").alias("words"))
    return elements.join(words, ["host", "role", "vector", "pages"], "left")


def _text(page: str, fixed: set[tuple[str, str]]) -> str:
    """The page's slots: blocks of its article with a word outside the template. A page without slots is taken whole.

    The article is all of main and of every article that is not a teaser, which is one of links that is not the longest.
    Without them, short blocks of links are left out before the first and after the last long block of text.
    """
    blocks = [b for b in blocks_of(page) if not b.other]
    slots = [b for b in blocks if any((b.path, w) not in fixed for w in b.words)] if fixed else blocks
    slots = slots or blocks
    size = lambda part: sum(len(b.words) for b in part)
    inside: dict[int, list[Block]] = {}
    for b in slots:
        if b.article:
            inside.setdefault(b.article, []).append(b)
    if inside:
        longest = max(inside, key=lambda a: (size(inside[a]), -a))
        teasers = {a for a, part in inside.items() if a not in (longest, -1) and sum(b.linked for b in part) > LINK_SHARE * size(part)}
        kept = [b for b in slots if b.article and b.article not in teasers]
    else:
        text = [i for i, b in enumerate(slots) if b.linked <= LINK_SHARE * len(b.words) and len(b.words) >= LONG_WORDS]
        first, last = (text[0], text[-1]) if text else (0, 0)
        kept = [b for i, b in enumerate(slots) if b.linked <= LINK_SHARE * len(b.words) or first < i < last or b.linked < len(b.words) >= LONG_WORDS]
    return "\n\n".join(" ".join(b.words) for b in kept)


def main_text(pages: DataFrame, url: str = "url", page: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """`pages` with text, the main text of each page.

    Null and empty pages have an empty text; pages without a host are one host; hosts of fewer than `least_pages` pages
    have no template, and their pages rest on markup alone. Repeated rows count as pages of their own. A column `text` is
    replaced.
    """
    # The page itself is moved once: the other columns travel beside it.
    others = {c: f"c{i}" for i, c in enumerate(pages.columns) if c != page}
    rest = F.struct(F.lit(0).alias("_"), *(pages[c].alias(place) for c, place in others.items()))
    named = pages.select(rest.alias("_page"), host_of(F.col(url)).alias("host"), F.col(page).alias("html"))
    found = templates(named.select("host", "html"), least_pages).where(F.size("words") > 0)
    fixed = found.groupBy("host").agg(F.collect_list("words").alias("fixed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {}
        for part in flat.slices(batches, "html", limit=SLICE_BYTES):
            texts = []
            for host, text, known in zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in ("host", "html", "fixed")), strict=True):
                if host not in at:
                    at = {host: {(w["under"], w["word"]) for words in known or () for w in words}}
                texts.append(_text(text or "", at[host]))
            yield with_columns(part.select(["_page", "html"]), {"text": pa.array(texts, pa.string())})

    kept = T.StructType([named.schema["_page"], named.schema["html"], T.StructField("text", T.StringType())])
    texts = named.join(fixed, "host", "left").mapInArrow(run, kept)
    return texts.select(*((F.col("html") if c == page else F.col("_page")[others[c]]).alias(c) for c in pages.columns if c != "text"), "text")
