import datetime as dt

from pyspark.sql import functions as F

from lorefield.operators import manifest as mf
from lorefield.schemas import DOC_STATUS, MANIFEST

def now():
    return F.lit("2024-05-01 00:00:00").cast("timestamp")


def manifest(spark, *rows):
    full = [(d, n, k, h, 63, 10, dt.datetime(2024, 1, i + 1)) for i, (d, n, k, h) in enumerate(rows)]
    return spark.createDataFrame(full, MANIFEST)


def status(spark, *rows):
    return spark.createDataFrame([(i, None, s, f, c, h, n, e) for i, s, f, c, h, n, e in rows], DOC_STATUS)


TOMBSTONE = ("dup-a", "failed", "handbook.pdf", None, None, None, "duplicate")
DONE = ("doc-original", "processed", "handbook.pdf", 63, "abc", 10, None)


def test_batch_is_resolved_in_arrival_order(spark):
    rows = [(1, "a.txt", "text", "Same  text"), (2, "b.txt", "text", " Same text\n"), (3, "c.txt", "text", "known"), (4, "d.txt", "text", " \n"), (5, "e.txt", "text", "other")]
    prepared = mf.prepare(spark.createDataFrame(rows, "seq long, file_name string, source_type string, text string"))
    known_hash = prepared.where("seq = 3").first().content_hash
    stored = manifest(spark, ("doc-k", "old.txt", "text", known_hash))
    out = {r.seq: r for r in mf.resolve_batch(prepared, stored).collect()}
    assert {s: r.deduped for s, r in out.items()} == {1: False, 2: True, 3: True, 5: False}
    assert out[2].file_name == "a.txt" and out[2].doc_id == out[1].doc_id
    assert out[3].doc_id == "doc-k" and out[3].file_name == "old.txt"
    assert prepared.where("seq = 4").first().error == mf.NO_CONTENT_ERROR
    assert sorted(r.seq for r in mf.new_documents(prepared, stored).collect()) == [1, 5]


def test_hot_hash_is_salted_and_whole(spark, monkeypatch):
    from lorefield.operators import skew

    rows = spark.range(3000).select(
        F.col("id").alias("seq"), F.lit("f").alias("file_name"), F.lit("text").alias("source_type"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("text"),
    )
    prepared = mf.prepare(rows)
    light = prepared.select("seq", "content_hash")
    lookup = light.groupBy("content_hash").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    joined = skew.lookup_join(light, lookup, "content_hash", "n", "seq", hot_rows=100)
    plain = light.join(lookup, "content_hash")
    assert joined.count() == 3000
    assert joined.select("seq", "first").exceptAll(plain.select("seq", "first")).count() == 0


def test_reconcile_and_rejected_upload(spark):
    st = status(spark, DONE, TOMBSTONE, ("doc-x", "processed", None, None, None, None, None))
    healed = mf.reconcile(st, manifest(spark), now())
    rows = {r.doc_id: r for r in healed.collect()}
    assert set(rows) == {"doc-original", "doc-x"}
    assert rows["doc-original"].source_type == "pdf" and rows["doc-original"].content_hash == mf.RECONCILED_HASH_PREFIX + "abc"
    assert rows["doc-x"].file_name == "doc-x" and rows["doc-x"].source_type == "unknown" and rows["doc-x"].chunk_count == 0
    assert {r.doc_id for r in mf.reconcile(st, manifest(spark), now(), skip_doc_id="doc-x").collect()} == {"doc-original"}
    rejected = spark.createDataFrame([(1, "handbook.pdf"), (2, "gone.pdf")], "seq long, file_name string")
    out = {r.seq: r for r in mf.resolve_rejected(rejected, healed).collect()}
    assert out[1].deduped and out[1].doc_id == "doc-original" and out[1].error is None
    assert not out[2].deduped and "Delete it from the knowledge base" in out[2].error


def test_delete_frees_the_name(spark):
    man = manifest(spark, ("doc-original", "handbook.pdf", "pdf", "h"), ("doc-2", "b.md", "markdown", "i"))
    st = status(spark, DONE, TOMBSTONE, ("dup-b", "failed", "b.md", None, None, None, None))
    chunks = spark.createDataFrame([("doc-original", 0), ("doc-2", 0)], "doc_id string, n int")
    out = mf.delete_documents(spark.createDataFrame([("doc-original",), ("nope",)], "doc_id string"), man, st, chunks=chunks)
    assert {(r.doc_id, r.deleted) for r in out["outcome"].collect()} == {("doc-original", True), ("nope", False)}
    assert [r.doc_id for r in out["manifest"].collect()] == ["doc-2"]
    assert [r.id for r in out["status"].collect()] == ["dup-b"]
    assert [r.doc_id for r in out["chunks"].collect()] == ["doc-2"]


def test_listing_and_lookups(spark):
    man = manifest(spark, ("a", "x.md", "markdown", "h"), ("b", "x.md", "markdown", "h"))
    assert [r.doc_id for r in mf.listing(man).collect()] == ["b", "a"]
    assert "content_hash" not in mf.listing(man).columns
    assert [r.doc_id for r in mf.find(man, "content_hash", "h").collect()] == ["a"]
    assert mf.find(man, "doc_id", "zzz").count() == 0


def test_table_keeps_ids_unique(spark):
    name = "manifest_under_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    mf.create_manifest(spark, name)
    mf.create_manifest(spark, name)
    rows = manifest(spark, ("a", "x.md", "markdown", "h"), ("b", "y.md", "markdown", "i"))
    mf.append_manifest(rows, name)
    mf.append_manifest(rows, name)
    assert spark.table(name).count() == 2
    mf.rewrite_manifest(spark.table(name).where("doc_id <> 'a'"), name)
    assert [r.doc_id for r in spark.table(name).collect()] == ["b"]
    spark.sql(f"DROP TABLE {name}")


def test_extensions(spark):
    names = ["A.PDF", "x.markdown", ".hidden", "a.tar.txt", "d.ir/file", "none", "x.docx"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select(mf.extension(F.col("n")).alias("e"), mf.source_type_of(F.col("n")).alias("t")).collect()
    assert [(r.e, r.t) for r in got] == [(".pdf", "pdf"), (".markdown", "markdown"), ("", None), (".txt", "text"), ("", None), ("", None), (".docx", None)]


def test_failed_and_resumable(spark):
    st = status(spark, DONE, ("p", "pending", "a", None, None, None, None), ("f", "failed", "b", None, None, None, ""))
    assert {r.id for r in mf.resumable(st).collect()} == {"p", "f"}
    assert [(r.doc_id, r.error) for r in mf.failed_inserts(st).collect()] == [("f", "Processing failed.")]
    ok, bad = mf.split_outcomes(spark.createDataFrame([("a", None), ("b", "boom")], "file_name string, error string"))
    assert ok.count() == 1 and bad.first().error == "boom"
