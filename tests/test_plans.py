import pytest
from pyspark.sql import functions as F

from lorefield.operators import vector as ve
from lorefield.plans import ask
from lorefield.plans.ingest import IndexOptions, append_tables, ingest, resume
from lorefield.schemas import DOC_STATUS, MANIFEST
from lorefield.session import shared_folder


def test_ingest_then_ask(spark):
    rows = [
        (1, "a.txt", "text", "Ada Byrne joined Northwind Labs. The lab works on interoperability with Kenji Mori."),
        (2, "b.txt", "text", "Kenji Mori moved to Osaka. Kenji Mori met Lena Ortiz there."),
        (3, "c.txt", "text", " Kenji Mori moved to Osaka.\nKenji Mori met Lena Ortiz there. "),
        (4, "d.txt", "text", "   "),
        (5, "e.txt", "text", "A plain note about weather and nothing else."),
    ]
    incoming = spark.createDataFrame(rows, "seq long, file_name string, source_type string, text string")
    empty = spark.createDataFrame([], MANIFEST)
    out = ingest(incoming, empty, F.lit("2024-01-01").cast("timestamp"), IndexOptions(embedder=ve.hashing_embedder(32)))
    assert {r.seq: r.deduped for r in out["results"].collect()} == {1: False, 2: False, 3: True, 5: False}
    assert [r.seq for r in out["errors"].collect()] == [4]
    assert {r.file_name: r.chunk_count for r in out["manifest"].collect()} == {"a.txt": 1, "b.txt": 1, "e.txt": 1}
    edges = {(r.src, r.dst): r.keywords for r in out["edges"].collect()}
    assert edges[("ada byrne", "northwind labs")] == "joined" and ("kenji mori", "lena ortiz") in edges
    folder = shared_folder(spark, "kb")
    append_tables(out, folder)
    again = ingest(incoming, spark.read.parquet(f"{folder}/manifest"), F.lit("2024-01-02").cast("timestamp"))
    assert all(r.deduped for r in again["results"].collect()) and again["chunks"].count() == 0
    questions = spark.createDataFrame([("q", "Where did Kenji Mori go?")], "query_id string, query_text string")
    options = ask.AskOptions(embedder=ve.hashing_embedder(32), top_n=2)
    context = ask.retrieve(questions, out["chunks"].select("chunk_id", "doc_id", "content"), out["vectors"], out["links"], out["edges"], options)
    top = context.orderBy("rerank").collect()
    assert len(top) == 2 and "Kenji Mori" in top[0].document
    entities, relations = ask.knowledge(questions, out["entities"], out["edges"], options)
    assert {"kenji mori", "lena ortiz"} <= {r.key for r in entities.collect()} and relations.count() >= 1


def test_resume_indexes_only_unfinished(spark):
    status = spark.createDataFrame([("a", None, "failed", "a", None, None, None, "x"), ("b", None, "processed", "b", 1, None, None, None)], DOC_STATUS)
    texts = spark.createDataFrame([("a", "Ada Byrne met Kenji Mori."), ("b", "x")], "doc_id string, text string")
    assert [r.doc_id for r in resume(status, texts)["chunks"].collect()] == ["a"]


def test_checkpoint_folder_comes_from_the_session(spark):
    from lorefield import session

    folder = session.ensure_checkpoint_dir(spark)
    assert folder and session.ensure_checkpoint_dir(spark) == folder


@pytest.mark.parametrize("name", ["hybrid_retrieval"])
def test_entry_point(spark, name):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
