import pytest
from pyspark.sql import functions as F

from lorefield.operators import vector as ve
from lorefield.plans.ingest import IndexOptions, index
from lorefield.plans.snapshots import Conflict, Tables
from lorefield.plans.store import Store, add_batch, remove_documents
from lorefield.session import shared_folder

COLUMNS = "seq long, file_name string, source_type string, text string"
OPTIONS = IndexOptions(embedder=ve.hashing_embedder(8))
FIRST = [
    (1, "a.txt", "text", "Ada Lindgren joined Harbor Works. Ada Lindgren met Omar Castell in Bergen."),
    (2, "b.txt", "text", "Omar Castell moved to Bergen."),
    (3, "b.txt", "text", "Another text under a taken name by Omar Castell."),
    (4, "c.txt", "text", " "),
]
SECOND = [(1, "d.txt", "text", "Omar  Castell moved to Bergen. "), (2, "a.txt", "text", "Changed text of Ada Lindgren."), (3, "e.txt", "text", "Omar Castell met Ada Lindgren again.")]


def tables(store):
    return {n: sorted(map(str, store.load(n).drop("date_added").collect())) for n in ("chunks", "vectors", "mentions", "pairs", "entities", "edges", "status", "manifest")}


def test_batches_twice_and_delete(spark):
    when = F.lit("2024-01-01").cast("timestamp")
    store = Store(spark, shared_folder(spark, "base"))
    assert all(not rows for rows in tables(store).values())
    one = add_batch(store, spark.createDataFrame(FIRST, COLUMNS), when, OPTIONS)
    names = {r.doc_id: r.file_name for r in store.load("manifest").collect()}
    assert sorted(names.values()) == ["a.txt", "b.txt"]
    assert {r.seq: (names[r.doc_id], r.deduped) for r in one["results"].collect()} == {1: ("a.txt", False), 2: ("b.txt", False), 3: ("b.txt", True)}
    assert [r.seq for r in one["errors"].collect()] == [4]
    before = tables(store)
    two = add_batch(store, spark.createDataFrame(SECOND, COLUMNS), when, OPTIONS)
    after = tables(store)
    assert after != before
    names = {r.doc_id: r.file_name for r in store.load("manifest").collect()}
    assert {r.seq: (names[r.doc_id], r.deduped) for r in two["results"].collect()} == {1: ("b.txt", True), 2: ("a.txt", True), 3: ("e.txt", False)}
    add_batch(store, spark.createDataFrame(SECOND, COLUMNS), when, OPTIONS)
    assert tables(store) == after
    texts = store.load("chunks").select("doc_id", F.col("content").alias("text"))
    whole = index(texts, OPTIONS)
    assert sorted(map(str, whole["edges"].select("src", "dst", "weight").collect())) == sorted(map(str, store.load("edges").select("src", "dst", "weight").collect()))
    third = [k for k, v in names.items() if v == "e.txt"]
    gone = remove_documents(store, spark.createDataFrame([(third[0],), ("nobody",)], "doc_id string"))
    assert {r.doc_id: r.deleted for r in gone.collect()} == {third[0]: True, "nobody": False}
    assert tables(store) == before


def files_of(store, name):
    return {row.f for row in store.load(name).select(F.input_file_name().alias("f")).distinct().collect()}


def test_a_change_that_dies_leaves_the_last_snapshot(spark, monkeypatch):
    when = F.lit("2024-01-01").cast("timestamp")
    store = Store(spark, shared_folder(spark, "base"), parts=4)
    add_batch(store, spark.createDataFrame(FIRST, COLUMNS), when, OPTIONS)
    before, number = tables(store), store.latest()

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr("lorefield.plans.store._merge_again", dies)
    with pytest.raises(RuntimeError, match="lost"):
        add_batch(store, spark.createDataFrame(SECOND, COLUMNS), when, OPTIONS)
    monkeypatch.undo()
    assert tables(store) == before and store.latest() == number
    # What the dead job wrote is no part of any snapshot.
    assert len(store.expire(keep=1)) == 8 and tables(store) == before
    add_batch(store, spark.createDataFrame(SECOND, COLUMNS), when, OPTIONS)
    assert store.load("manifest").count() == 3


def test_untouched_parts_keep_their_files(spark):
    store = Tables(spark, shared_folder(spark, "tables"), {"t": "k long, v string"}, {"t": ["k"]}, parts=8)
    change = store.begin()
    change.append("t", spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    assert change.commit() == 1
    before = files_of(store, "t")
    change = store.begin()
    parts = store.parts_in("t", spark.createDataFrame([(7,)], "k long"))
    change.rewrite("t", change.load("t", parts).withColumn("v", F.when(F.col("k") == 7, F.lit("new")).otherwise(F.col("v"))), parts)
    change.commit()
    after = files_of(store, "t")
    assert len(parts) == 1 and len(before & after) == len(before) - 1 and len(after - before) == 1
    assert {(r.k, r.v, r.change) for r in store.changes("t", 1).collect()} == {(7, "new", "added"), (7, "old", "removed")}
    assert store.load("t", at=1).where("v = 'new'").count() == 0 and store.load("t").count() == 100
    with pytest.raises(ValueError, match="not rewritten"):
        store.begin().rewrite("t", spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v")), parts)


def test_one_of_two_writers_starts_again(spark):
    store = Tables(spark, shared_folder(spark, "tables"), {"t": "k long"}, {"t": ["k"]}, parts=2)
    one, two = store.begin(), store.begin()
    one.append("t", spark.range(3).select(F.col("id").alias("k")))
    two.append("t", spark.range(5).select(F.col("id").alias("k")))
    assert two.commit() == 1
    with pytest.raises(Conflict):
        one.commit()
    assert store.load("t").count() == 5


def test_runs_are_joined_and_a_broken_snapshot_is_passed_over(spark):
    store = Tables(spark, shared_folder(spark, "tables"), {"t": "k long"}, {"t": ["k"]}, parts=2)
    for i in range(4):
        change = store.begin()
        change.append("t", spark.createDataFrame([(i,), (i + 10,), (i + 20,)], "k long"))
        change.commit()
    rows = sorted(r.k for r in store.load("t").collect())
    assert store.compact("t", max_runs=3) == 5 and store.compact("t", max_runs=3) is None
    assert store.changes("t", 4).count() == 0 and sorted(r.k for r in store.load("t").collect()) == rows
    store._files().create(store._path("_snapshots", "000000000006.json"), False).close()
    assert store.latest() == 5 and store.snapshots() == [1, 2, 3, 4, 5]
    change = store.begin()
    change.append("t", spark.createDataFrame([(99,)], "k long"))
    assert change.commit() == 7 and store.load("t").count() == 13


def test_a_batch_is_embedded_block_by_block(spark):
    """Vectors of a whole Arrow batch would be held at once by every worker."""
    texts = spark.range(3 * ve.EMBED_ROWS // 2, numPartitions=1).select(F.col("id").cast("string").alias("content"))
    calls = ve.embed(texts, embedder=lambda batch: [[float(len(batch))]] * len(batch)).select(F.col("embedding")[0].alias("n"))
    assert calls.count() == 3 * ve.EMBED_ROWS // 2 and calls.agg(F.max("n")).first()[0] <= ve.EMBED_ROWS


def test_texts_are_not_stored_again_on_their_way_into_the_base(spark, monkeypatch):
    from lorefield.plans import store as module

    kept = []
    plain = module.checkpointed
    monkeypatch.setattr(module, "checkpointed", lambda df, *by: kept.append(df.columns) or plain(df, *by))
    add_batch(Store(spark, shared_folder(spark, "base")), spark.createDataFrame(FIRST, COLUMNS), F.lit("2024-01-01").cast("timestamp"), OPTIONS)
    assert kept and not any({"content", "description"} & set(columns) for columns in kept)


def test_a_deletion_writes_rows_where_they_lie(spark, monkeypatch):
    from lorefield.plans.snapshots import Change

    when = F.lit("2024-01-01").cast("timestamp")
    store = Store(spark, shared_folder(spark, "base"))
    add_batch(store, spark.createDataFrame(FIRST, COLUMNS), when, OPTIONS)
    dealt, plain = {}, Change._write

    def spy(self, name, rows, in_place=False):
        dealt[name] = not in_place
        return plain(self, name, rows, in_place)

    monkeypatch.setattr(Change, "_write", spy)
    gone = store.load("manifest").where("file_name = 'a.txt'").select("doc_id")
    remove_documents(store, gone)
    assert {n for n, yes in dealt.items() if yes} <= {"entities", "edges"} and {"chunks", "vectors", "mentions", "pairs"} <= set(dealt)
    assert store.load("chunks").count() == 1
