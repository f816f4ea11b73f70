import datetime as dt

from pyspark.sql import functions as F

from lorefield.functions import markdown as md
from lorefield.functions import urls, web
from lorefield.functions.article import article_markdown_udf, markdown_of
from lorefield.sources import files as sf
from lorefield.sources import synthetic as sy
from lorefield.sources import web as sw

PARAGRAPH = " ".join(f"On day {i} the crew measured the tide at the north pier and wrote {i * 3} centimetres." for i in range(10))
PAGE = f"""<html><head><meta property="og:site_name" content="Tide Log"><meta property="og:title" content="Tides at the Pier">
<meta property="og:description" content="Ten days of readings."></head>
<body><nav><ul><li><a href="/log">Log book</a></li></ul></nav>
<article><p>{PARAGRAPH}</p><p>{PARAGRAPH} The gauge is old [2].</p>
<table><tr><th>day</th><th>cm</th></tr><tr><td>4</td><td>12</td></tr></table><p><a href="/all">All logs</a></p>
<h2>Related Articles</h2><p>Wind at the pier.</p></article><footer>Imprint and contact.</footer></body></html>"""


def test_article_is_cleaned(spark):
    rows = [("p", PAGE, "zenrows"), ("q", "<html><body><nav>menu</nav></body></html>", "trafilatura")]
    pages = spark.createDataFrame(rows, "url string, html string, source string")
    found = {r.url: r for r in sw.article_rows(pages, article_markdown_udf()).collect()}
    page, bare = found["p"], found["q"]
    assert (page.title, page.source_type, page.error) == ("Tides at the Pier", "article_zenrows", None)
    assert page.body.startswith("# Tides at the Pier\n\nTen days of readings.\n\nOn day 0")
    assert "wrote 27 centimetres" in page.body and "| 4 | 12 |" in page.body
    assert not [w for w in ("Log book", "Imprint", "Related Articles", "Wind at", "[2]", "All logs") if w in page.body]
    assert (bare.source_type, bare.error) == ("article", "No article content extracted from: q")


def test_title_like_a_marker_does_not_erase_the_page(one):
    out = one(lambda b: web.finish_article(b, F.lit("References for all"), F.lit(None).cast("string")), b="Body text. [12]")
    assert out == "# References for all\n\nBody text."


def test_markdown_reader():
    html = "<body><h2>T</h2><p>a <b>bold</b> <i>it</i> <img src='i.png' alt='x'></p><ul><li>one<li>two</ul><script>var t='</p>'</script></body>"
    assert markdown_of(html) == "## T\n\na **bold** *it* ![x](i.png)\n\n- one\n\n- two"
    assert markdown_of("") is None and markdown_of("<body> </body>") is None


def test_url_identity(one):
    assert one(urls.cache_key, u="https://a.test/cached") == one(urls.cache_key, u=" HTTPS://A.test/cached/#top")
    assert one(urls.canonical_url, u="HTTP://X.Y/a/B//?q=1#z") == "http://x.y/a/B?q=1"
    assert one(urls.is_video_url, u="https://WWW.YouTube.com/watch?v=abc") is True
    assert one(urls.video_id, u="https://youtu.be/dQw4w9WgXcQ?t=1") == "dQw4w9WgXcQ"
    assert one(urls.video_id, u="https://youtube.com/watch?v=short") is None
    assert one(urls.is_clippable, u="chrome://newtab") is False


def test_ladder_cache_and_fallback(spark):
    cols = "url string, attempt int, html string, error string"
    attempts = spark.createDataFrame([("js", 1, "too short", None), ("js", 2, "x" * 300, None), ("slow", 1, None, "timeout"), ("slow", 2, None, "timeout"), ("late", 3, "y" * 300, None)], cols)
    assert [(r.url, r.attempt) for r in sw.scrape_ladder(attempts).collect()] == [("js", 2)]
    requests = spark.createDataFrame([("js",), ("slow",), ("dead",)], "url string")
    direct = spark.createDataFrame([("slow", "html"), ("js", "no")], "url string, html string")
    out = {r.url: (r.source, r.error) for r in sw.fetch_with_fallback(requests, attempts, direct).collect()}
    assert out == {"js": ("zenrows", None), "slow": ("trafilatura", None), "dead": (None, "Could not fetch URL: dead")}
    cache = spark.createDataFrame([("https://a.test/cached", "T", "zenrows", "b")], "u string, title string, source string, body string")
    cache = cache.select(urls.cache_key(F.col("u")).alias("cache_key"), "title", "source", "body")
    hits, misses = sw.cache_lookup(spark.createDataFrame([("https://a.test/cached/#top",), ("https://a.test/n",)], "url string"), cache)
    assert hits.first().source_type == "article_zenrows" and misses.first().url == "https://a.test/n"


def test_cache_file_shape(spark):
    df = spark.createDataFrame([("https://a", 'He said: "x"', "", "one two\n---\nthree")], "url string, title string, author string, body string")
    text = df.select(sw.cache_file(F.col("url"), [("title", F.col("title")), ("author", F.col("author"))], F.col("body"), F.lit("2024"), F.lit("zenrows")).alias("value"))
    raw = text.first().value
    assert raw.startswith("---\n") and "author" not in raw and "word_count" in raw
    back = sw.read_cache_files(text).first()
    assert back.title == 'He said: "x"' and back.body == "one two\n---\nthree" and back.metadata["word_count"] == "4"
    assert sw.read_cache_files(spark.createDataFrame([("no header",)], "value string")).count() == 0


def test_recrawl_and_politeness(spark):
    cols = "url string, content_hash string, crawled_at int"
    merged, fresh = sw.recrawl(spark.createDataFrame([("u", "h", 5)], cols), spark.createDataFrame([("u", "h", 9), ("v", "n", 7)], cols))
    assert {(r.content_hash, r.crawled_at) for r in merged.collect()} == {("h", 9), ("n", 7)}
    assert [r.content_hash for r in fresh.collect()] == ["n"]
    t = dt.datetime(2024, 1, 1, 23, 59, 59)
    rows = [(1, "http://a/x", t), (2, "http://a/y", t + dt.timedelta(milliseconds=400)), (3, "http://a/z", t + dt.timedelta(seconds=2)), (4, "http://b/", t)]
    got = {r.page_id: (r.gap_seconds, r.too_soon) for r in sw.politeness(spark.createDataFrame(rows, "page_id long, url string, crawled_at timestamp")).collect()}
    assert got[1] == (None, False) and got[2][1] is True and round(got[3][0], 3) == 1.6 and got[4] == (None, False)


def test_files_isolate_errors(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"  ok \xff\n")
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.docx").write_bytes(b"zip")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.md").write_text("# T")
    listed = sf.list_files(spark, str(tmp_path))
    rows = {r.file_name: r for r in sf.parse_files(listed).collect()}
    assert rows["a.txt"].text == "ok �" and rows["a.txt"].source_type == "text"
    assert rows["d.md"].source_type == "markdown"
    assert rows["c.docx"].error == "Unsupported file type: .docx"
    assert rows["b.PDF"].source_type == "pdf" and rows["b.PDF"].error
    assert sf.list_files(spark, str(tmp_path), accepted_only=True).count() == 2


def test_transcripts(spark):
    rows = [("v", "en", 1, "world"), ("v", "en", 0, "hello"), ("v", "de", 0, "hallo"), ("w", "en", 0, " ")]
    got = {r.video_id: (r.text, r.error) for r in sf.transcript_text(spark.createDataFrame(rows, "video_id string, lang string, pos int, text string")).collect()}
    assert got["v"] == ("hello world", None) and got["w"][1].startswith("No transcript")


def test_generated_corpus(spark):
    rows = sy.sections(spark, 130).orderBy("section").collect()
    assert rows[1].text.startswith("Entry 1. Tomasz Brandt of the Mill Street Gallery bought a tapestry in Valencia in 1871.")
    assert "lent it to the Copperfield Archive, where Rosa Whitlock" in rows[1].text and "in 1870." in rows[120].text
    total = sum(len(r.text.split()) for r in sy.corpus(spark, 2000).collect())
    assert 1900 <= total <= 2200


def test_markdown_subset(one):
    src = "# Head & <b>\n- one **x**\n- two `c`\n1. uno\n\ntext *em* [l](https://a.b/c)\n#### four"
    assert one(md.render, s=src) == (
        "<h3>Head &amp; &lt;b&gt;</h3><ul><li>one <strong>x</strong></li><li>two <code>c</code></li></ul><ol><li>uno</li></ol>"
        '<p>text <em>em</em> <a href="https://a.b/c" target="_blank" rel="noopener noreferrer">l</a></p><p>#### four</p>'
    )
