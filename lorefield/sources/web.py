"""Scraped pages: attempt ladder, cache in front, clean-up, re-crawl and politeness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions import urls, web
from lorefield.functions.arrays import keep_truthy, let
from lorefield.functions.text import falsy, py_strip, word_count
from lorefield.operators.skew import running

# --- fixed values ---
ATTEMPT_FLAGS = ((False, False), (True, True))
TIMEOUT_SECONDS = 25
CACHE_PARTS = 3
MIN_DELAY_SECONDS = 1.0
# --------------------


def scrape_ladder(attempts: DataFrame) -> DataFrame:
    """First attempt per URL whose stripped body is long enough: (url, html, attempt). At most two attempts count.

    `attempts`: (url, attempt, html, error); a failed attempt has an error.
    """
    body = py_strip(F.col("html"))
    good = attempts.where(
        (F.col("attempt") <= len(ATTEMPT_FLAGS)) & F.col("error").isNull() & (F.length(body) >= web.MIN_BODY_CHARS)
    )
    return good.groupBy("url").agg(F.min_by(body, "attempt").alias("html"), F.min("attempt").alias("attempt"))


def fetch_with_fallback(requests: DataFrame, attempts: DataFrame, direct: DataFrame) -> DataFrame:
    """(url, html, source): the ladder's page, else the direct fetch; an error row when both are missing."""
    laddered = scrape_ladder(attempts).select("url", F.col("html").alias("_z"))
    fetched = direct.select("url", F.col("html").alias("_d"))
    joined = requests.select("url").distinct().join(laddered, "url", "left").join(fetched, "url", "left")
    direct_html = F.nullif(F.col("_d"), F.lit(""))
    return joined.select(
        "url",
        F.coalesce("_z", direct_html).alias("html"),
        F.when(F.col("_z").isNotNull(), web.SCRAPED).when(direct_html.isNotNull(), web.FETCHED).alias("source"),
        F.when(F.coalesce("_z", direct_html).isNull(), F.concat(F.lit(web.NOT_FETCHED), F.col("url"))).alias("error"),
    )


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requested URLs by cache key. `cache`: (cache_key, title, source, body)."""
    keyed = requests.withColumn("cache_key", urls.cache_key(F.col("url")))
    stored = cache.select("cache_key", "title", "source", "body")
    hits = keyed.join(stored, "cache_key").withColumn("source_type", web.source_type(F.col("source")))
    return hits, keyed.join(stored.select("cache_key"), "cache_key", "left_anti")


def article_rows(pages: DataFrame, markdown) -> DataFrame:
    """(url, title, body, source, source_type, error) from (url, html, source); `markdown` is the extraction function."""
    title, dek = web.page_title(F.col("html")), web.meta_content(F.col("html"), "og:description")
    staged = pages.withColumn("_md", markdown(F.col("html"))).withColumn("title", title)
    staged = staged.withColumn("body", web.finish_article(F.col("_md"), F.col("title"), dek))
    missing = F.concat(F.lit(web.NO_ARTICLE), F.col("url"))
    return staged.select(
        "url",
        "title",
        "body",
        "source",
        web.source_type(F.col("source")).alias("source_type"),
        F.when(F.coalesce("body", F.lit("")) == "", missing).alias("error"),
    )


def frontmatter(fields: list[tuple[str, Column]]) -> Column:
    """YAML header of a cache file. JSON strings are YAML scalars, so quoting is safe; empty fields are left out."""
    lines = [
        F.when(falsy(value, F.lit(None).cast("string")).isNotNull(), F.concat(F.lit(f"{name}: "), _json_scalar(value), F.lit("\n"))).otherwise("")
        for name, value in fields
    ]
    return F.concat(*lines)


def _json_scalar(value: Column) -> Column:
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, 2, F.length(wrapped) - 2)


def cache_file(url: Column, metadata: list[tuple[str, Column]], body: Column, scraped_at: Column, source: Column) -> Column:
    """Whole text of a cache file: header between `---` lines, then the body."""
    def build(text: Column) -> Column:
        count = word_count(text).cast("string")
        header = frontmatter([("url", url), *metadata, ("scraped_at", scraped_at), ("source", source), ("word_count", count)])
        return F.concat(F.lit("---\n"), header, F.lit("---\n\n"), text, F.lit("\n"))

    return let(body, build)


def _yaml_map(text: str | None) -> dict[str, str]:
    try:
        import yaml

        loaded = yaml.safe_load(text or "") or {}
    except ImportError:
        import json

        loaded = {}
        for line in (text or "").splitlines():
            name, _, value = line.partition(": ")
            try:
                loaded[name] = json.loads(value)
            except ValueError:
                loaded[name] = value
    except Exception:  # an unreadable header counts as empty
        loaded = {}
    return {str(k): str(v) for k, v in loaded.items() if v is not None} if isinstance(loaded, dict) else {}


def yaml_map_udf():
    @F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
    def run(headers: pd.Series) -> pd.Series:
        return headers.map(lambda h: None if h is None else _yaml_map(h))

    return run


def read_cache_files(files: DataFrame, value: str = "value") -> DataFrame:
    """Parse cache file texts; those without a complete header are dropped."""
    split = files.withColumn("_p", F.split(F.col(value), "---\n", CACHE_PARTS))
    # Incomplete files get no header; testing the parsed header keeps the costly split out of a pushed-down filter.
    header = F.when(F.size("_p") == CACHE_PARTS, F.col("_p")[1])
    parsed = split.withColumn("_m", yaml_map_udf()(header)).where(F.col("_m").isNotNull())
    source = F.try_element_at("_m", F.lit("source"))
    return parsed.select(
        *[c for c in files.columns if c != value],
        keep_truthy(F.col("_m")).alias("metadata"),
        F.try_element_at("_m", F.lit("title")).alias("title"),
        source.alias("source"),
        web.source_type(source).alias("source_type"),
        py_strip(F.col("_p")[2]).alias("body"),
    )


def dispatch(requests: DataFrame) -> DataFrame:
    """Which branch handles a URL, and the video id where it is a video."""
    url = F.col("url")
    kind = F.when(urls.is_video_url(url), "video").otherwise("article")
    bad = urls.is_video_url(url) & urls.video_id(url).isNull()
    return requests.withColumns(
        {
            "branch": kind,
            "video_id": F.when(kind == "video", urls.video_id(url)),
            "error": F.when(bad, F.concat(F.lit(web.NO_VIDEO_ID), url)),
        }
    )


def recrawl(stored: DataFrame, crawled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, to_embed): known content only gets a later crawled_at; only unknown content is embedded.

    Both inputs: (url, content_hash, crawled_at).
    """
    merged = (
        stored.select("content_hash", "url", "crawled_at")
        .unionByName(crawled.select("content_hash", "url", "crawled_at"))
        .groupBy("content_hash")
        .agg(F.max("crawled_at").alias("crawled_at"), F.min("url").alias("url"))
    )
    fresh = crawled.select("content_hash").distinct().join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return merged, fresh


def politeness(crawled: DataFrame, min_delay: float = MIN_DELAY_SECONDS, segment: str = "day") -> DataFrame:
    """Seconds since the host's previous request and whether that was too soon. `crawled`: (page_id, url, crawled_at).

    The previous request is the running maximum of the earlier times, so a host with most of the pages is still
    scanned in day-sized pieces.
    """
    keyed = crawled.select(
        "page_id", urls.host(F.col("url")).alias("host"), "crawled_at", F.date_trunc(segment, "crawled_at").alias("_seg")
    )
    with_last = running(keyed, ["host"], "_seg", ["crawled_at", "page_id"], F.col("crawled_at"), "previous", "max", exclusive=True)
    gap = F.col("crawled_at").cast("double") - F.col("previous").cast("double")
    return with_last.select("page_id", "host", gap.alias("gap_seconds"), F.coalesce(gap < min_delay, F.lit(False)).alias("too_soon"))
