"""The article source from a URL to its text: cache, attempt ladder, direct fetch, clean-up and write-through as one job.

Fetched pages come in as tables, since a job makes no network calls: what a fetcher would ask for next is `to_fetch`. The cache
is a table of whole cache files, dealt by the hash of their key; a batch reads only the parts its own keys can be in, and what
it fetches becomes one more run, committed as one snapshot, so a batch that dies or runs again leaves no half of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.functions import urls, web
from lorefield.functions.article import article_markdown_udf
from lorefield.plans.snapshots import PARTS, Tables
from lorefield.session import checkpointed
from lorefield.sources import web as sw

FILES = "files"
# Page-declared fields that go into the header of a cache file, with the property that holds each.
DECLARED = {"author": "author", "date": "article:published_time", "sitename": "og:site_name", "description": "og:description"}


class ArticleCache(Tables):
    """Cache files (cache_key, url, value): `value` is the whole text of a file, header and body."""

    def __init__(self, spark: SparkSession, base: str, parts: int = PARTS):
        super().__init__(spark, base, {FILES: "cache_key string, url string, value string"}, {FILES: ["cache_key"]}, parts)


def keyed(requests: DataFrame) -> DataFrame:
    """Requests (seq, url) with the cache key of their URL; those without a URL are left out."""
    return requests.where(F.col("url").isNotNull()).withColumn("cache_key", urls.cache_key(F.col("url")))


def stored_files(cache: ArticleCache, wanted: DataFrame) -> DataFrame:
    """Parsed cache files of the wanted keys (cache_key). A file whose header is incomplete counts as missing."""
    held = cache.load(FILES, parts=cache.parts_in(FILES, wanted)).join(wanted.select("cache_key").distinct(), "cache_key", "left_semi")
    # Two runs may hold a file of the same key, if two batches have fetched it at the same time.
    one = held.groupBy("cache_key").agg(F.min("value").alias("value"))
    return sw.read_cache_files(one)


def to_fetch(cache: ArticleCache, requests: DataFrame) -> DataFrame:
    """(cache_key, url) of pages to fetch: of URLs with one key that the cache lacks, the first in order."""
    asked = keyed(requests)
    files = stored_files(cache, asked).select("cache_key")
    return asked.join(files, "cache_key", "left_anti").groupBy("cache_key").agg(F.min_by("url", F.struct("seq", "url")).alias("url"))


def cleaned(pages: DataFrame, markdown=None) -> DataFrame:
    """article_rows of (url, html, source) with the page-declared fields."""
    fields = {name: web.meta_content(F.col("html"), prop) for name, prop in DECLARED.items()}
    rows = sw.article_rows(pages, markdown or article_markdown_udf())
    return rows.join(pages.select("url", *(column.alias(name) for name, column in fields.items())), "url")


def articles(cache: ArticleCache, requests: DataFrame, attempts: DataFrame, direct: DataFrame, scraped_at: Column, markdown=None) -> DataFrame:
    """(seq, url, text, title, source_type, cached, error) of every request (seq, url), and the fetched pages put into the cache.

    `attempts` (url, attempt, html, error) and `direct` (url, html) hold what fetching gave for the URLs of `to_fetch`. A cached page
    is not fetched again, whatever else these tables hold. URLs with the same key share one page: the first is fetched, the others
    are served from the cache it went to. A page that could not be fetched, or has no article, gives an error row, and no file.
    """
    asked = checkpointed(keyed(requests))
    files = checkpointed(stored_files(cache, asked).select("cache_key", "title", "source_type", "body"))
    wanted = checkpointed(to_fetch(cache, requests))
    only = wanted.select("url").distinct()
    fetched = sw.fetch_with_fallback(only, attempts.join(only, "url", "left_semi"), direct.join(only, "url", "left_semi"))
    pages = checkpointed(fetched)
    clean = cleaned(pages.where(F.col("error").isNull()).select("url", "html", "source"), markdown)
    header = [(name, F.col(name)) for name in ("title", *DECLARED)]
    value = F.when(F.col("error").isNull(), sw.cache_file(F.col("url"), header, F.col("body"), scraped_at.cast("string"), F.col("source")))
    fresh = checkpointed(wanted.join(clean.select("*", value.alias("value")), "url"))
    new = fresh.where(F.col("value").isNotNull()).select("cache_key", "url", "value")
    if not new.isEmpty():
        change = cache.begin()
        change.append(FILES, new)
        change.commit()
    lost = wanted.join(pages.where(F.col("error").isNotNull()).select("url", "error"), "url").select("cache_key", "error")
    empty = fresh.where(F.col("error").isNotNull()).select("cache_key", "error")
    made = fresh.where(F.col("error").isNull()).select("cache_key", "title", "source_type", "body", F.lit(None).cast("string").alias("error"))
    none = [F.lit(None).cast("string").alias(c) for c in ("title", "source_type", "body")]
    answers = files.select("*", F.lit(None).cast("string").alias("error"), F.lit(True).alias("held")).unionByName(
        made.unionByName(lost.unionByName(empty).select("cache_key", *none, "error")).withColumn("held", F.lit(False))
    )
    # The request that a page was fetched for is the only one not served from the cache.
    first = asked.groupBy("cache_key").agg(F.min(F.struct("seq", "url")).alias("first"))
    joined = asked.join(answers, "cache_key").join(first, "cache_key")
    cached = F.col("error").isNull() & (F.col("held") | (F.struct("seq", "url") != F.col("first")))
    return joined.select("seq", "url", F.col("body").alias("text"), "title", "source_type", cached.alias("cached"), "error")
