"""The article source end to end: cache, ladder, direct fetch, clean-up, write-through."""

import pytest
from pyspark.sql import functions as F

from lorefield.session import shared_folder
from lorefield.sources import articles as ar
from tests.test_web_sources import PAGE

WHEN = "2024-05-01T00:00:00+00:00"
ATTEMPT, DIRECT = "url string, attempt int, html string, error string", "url string, html string"


@pytest.fixture()
def cache(spark):
    return ar.ArticleCache(spark, shared_folder(spark, "cache"), parts=4)


def ask(spark, cache, urls, attempts=(), direct=()):
    requests = spark.createDataFrame(list(enumerate(urls)), "seq long, url string")
    rows = ar.articles(cache, requests, spark.createDataFrame(list(attempts), ATTEMPT), spark.createDataFrame(list(direct), DIRECT), F.lit(WHEN)).collect()
    return {r.seq: r for r in rows}


def test_scraped_page_is_cleaned_and_written(spark, cache):
    row = ask(spark, cache, ["https://a.test/post"], [("https://a.test/post", 1, PAGE, None)])[0]
    assert (row.title, row.source_type, row.cached, row.error) == ("Tides at the Pier", "article_zenrows", False, None)
    assert "Related Articles" not in row.text and "[2]" not in row.text and "wrote 27 centimetres" in row.text
    file = cache.load(ar.FILES).first()
    assert file.value.startswith("---\nurl: ") and 'source: "zenrows"' in file.value and 'sitename: "Tide Log"' in file.value
    assert 'description: "Ten days of readings."' in file.value and file.value.endswith(row.text + "\n")


def test_short_body_takes_the_second_attempt_and_failures_the_direct_fetch(spark, cache):
    attempts = [("https://a.test/js", 1, "too short", None), ("https://a.test/js", 2, PAGE, None)]
    attempts += [("https://a.test/slow", 1, None, "timeout"), ("https://a.test/slow", 2, None, "timeout"), ("https://a.test/gone", 1, None, "404")]
    direct = [("https://a.test/slow", PAGE), ("https://a.test/bare", "<html><body><nav>menu</nav></body></html>")]
    urls = ["https://a.test/js", "https://a.test/slow", "https://a.test/gone", "https://a.test/bare"]
    rows = ask(spark, cache, urls, attempts, direct)
    assert [rows[i].source_type for i in range(4)] == ["article_zenrows", "article", None, None]
    assert [rows[i].error for i in (2, 3)] == ["Could not fetch URL: https://a.test/gone", "No article content extracted from: https://a.test/bare"]
    assert cache.load(ar.FILES).count() == 2


def test_cache_hit_needs_no_page_and_the_same_key_shares_one(spark, cache):
    first = ask(spark, cache, ["https://a.test/cached", "HTTPS://A.test/cached#x"], [("https://a.test/cached", 1, PAGE, None)])
    assert [first[i].cached for i in range(2)] == [False, True] and first[0].text == first[1].text
    assert ar.to_fetch(cache, spark.createDataFrame([(0, "https://a.test/cached/#top"), (1, "https://b.test/new"), (2, None)], "seq long, url string")).select("url").collect() == [("https://b.test/new",)]
    again = ask(spark, cache, ["https://a.test/cached/#top"], [("https://a.test/cached/#top", 1, PAGE.replace("Tides", "Other"), None)])[0]
    assert (again.cached, again.title, again.source_type, again.text) == (True, "Tides at the Pier", "article_zenrows", first[0].text)
    assert cache.load(ar.FILES).count() == 1 and cache.snapshots() == [1]


def test_a_batch_that_died_is_fetched_again(spark, cache, monkeypatch):
    monkeypatch.setattr("lorefield.plans.snapshots.Change.commit", lambda self: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        ask(spark, cache, ["https://a.test/post"], [("https://a.test/post", 1, PAGE, None)])
    monkeypatch.undo()
    assert cache.load(ar.FILES).count() == 0
    assert ask(spark, cache, ["https://a.test/post"], [("https://a.test/post", 1, PAGE, None)])[0].cached is False


def test_no_requests(spark, cache):
    assert ask(spark, cache, []) == {} and ask(spark, cache, [None]) == {}
