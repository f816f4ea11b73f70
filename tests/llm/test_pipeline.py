"""The pipeline stage by stage against plain versions, and the registered queries on the smallest tables."""

import random
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tests.llm import plain  # noqa: E402

BASE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(BASE).exists(), reason="test tables are not mounted")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, n_lines string, items string, _doc string"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest tables with edge cases, and with columns named like those the operators add."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{BASE}/documents.parquet'").fetchall()
    item = duckdb.sql(f"SELECT text FROM '{BASE}/benchmark.parquet' ORDER BY item_id").fetchall()[0][0]
    body = rows[0][1]
    rows += [(9001, None, "en", None, None), (9002, "", None, None, 0), (9003, "123 ...", "en", "x", 7), (9004, body, "fr", "x", len(body)), (9005, f"Before it. {item} After it.", "en", "x", 1)]
    rows = [(*r, "mine", "mine", "mine", "mine") for r in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, COLUMNS).repartition(4)


def pairs(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def kept_whole(before, after):
    """The rows that stay are unchanged, extra columns included."""
    assert after.columns == before.columns
    old = {r.doc_id: r for r in before.collect()}
    return all(old[r.doc_id] == r for r in after.collect())


def test_language_stage_drops_texts_without_letters_only(spark, docs):
    got = stage("language")(spark, docs, BASE)
    assert kept_whole(docs, got)
    lost = {d for d, _ in pairs(docs)} - {d for d, _ in pairs(got)}
    assert lost == {d for d, t in pairs(docs) if not any(c.isalpha() for c in t or "")}


def test_line_stage(spark, docs):
    got = stage("line dedup")(spark, docs, BASE)
    assert got.columns == docs.columns
    want = plain.line_dedup(pairs(docs))
    old = {r.doc_id: r for r in docs.collect()}
    for r in got.collect():
        changed = want[r.doc_id][1] > 0
        assert r.text == (want[r.doc_id][2] if changed else old[r.doc_id].text)
        assert r.n_chars == (len(r.text) if changed else old[r.doc_id].n_chars) and r.items == r._doc == "mine"


def test_near_copies_stage(spark, docs):
    got = stage("near copies")(spark, docs, BASE)
    assert kept_whole(docs, got)
    want = plain.near_duplicates(pairs(docs), 5)
    assert {d for d, _ in pairs(got)} == {d for d, (_, c) in want.items() if c == d}


def test_test_items_stage(spark, docs):
    got = stage("test items")(spark, docs, BASE)
    assert kept_whole(docs, got)
    items = duckdb.sql(f"SELECT item_id, text FROM '{BASE}/benchmark.parquet'").fetchall()
    want = plain.contamination(pairs(docs), items)
    assert {d for d, _ in pairs(got)} == {d for d, (_, hit, _) in want.items() if not hit} and want[9005][1]


def test_stages_take_no_rows(spark, docs):
    none = docs.limit(0)
    for name, run in corpus_pipeline.STAGES:
        got = run(spark, none, BASE)
        assert got.count() == 0, name
        assert name == "packing" or got.columns == docs.columns


def test_run_is_its_stages(spark):
    rows = corpus_pipeline.run(spark, BASE)
    ids = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    given = pairs(spark.read.parquet(f"{BASE}/documents.parquet"))
    assert ids and ids <= {d for d, _ in given}
    ends = rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t")
    assert ends.count() == 0
    lettered = [(d, t) for d, t in given if any(c.isalpha() for c in t or "")]
    lined = [(d, text) for d, (_, _, text) in plain.line_dedup(lettered).items()]
    single = {d for d, (_, c) in plain.near_duplicates(lined, 5).items() if c == d}
    items = duckdb.sql(f"SELECT item_id, text FROM '{BASE}/benchmark.parquet'").fetchall()
    clean = {d for d, (_, hit, _) in plain.contamination([x for x in lined if x[0] in single], items).items() if not hit}
    assert ids == clean


def test_every_query_covers_its_table(spark):
    import __spark_entry__ as entry

    queries = entry.queries()
    for number in (1, 2, 3, 4, 5, 6, 8, 9, 10):  # 7 has rows for passages only
        (name,) = [q for q in queries if q.startswith(f"op{number}_")]
        rows = queries[name](spark, BASE)
        source, key = ("pages", "page_id") if number == 5 else ("documents", "doc_id")
        got = {r[0] for r in rows.select(key).distinct().collect()}
        assert got == {r[0] for r in spark.read.parquet(f"{BASE}/{source}.parquet").select(key).collect()}, name


def test_held_out_languages_and_toxicity(spark):
    import __spark_entry__ as entry

    base = "/root/testdata/sf0.01"
    found = entry.queries()["op10_language_id"](spark, base).where("held_out")
    given = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "lang")
    right = found.join(given, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    scores = entry.queries()["op9_toxicity"](spark, base).where("held_out")
    marks = spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic")
    right = scores.join(marks, "doc_id").agg(F.avg((F.col("toxic") == F.col("predicted")).cast("int"))).first()[0]
    assert right > 0.93
