import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorefield.functions import vectors as vf
from lorefield.operators import retrieve as rt
from lorefield.operators import vector as ve


def vectors_of(spark, n=300, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[n // 2] = m[0]
    m[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "vec_id long, embedding array<float>")
    return m.astype("float32").astype("float64"), df


def top_by_hand(m, q, k):
    norms = np.linalg.norm(m, axis=1) * np.linalg.norm(q)
    s = np.round(np.divide(m @ q, norms, out=np.zeros(len(m)), where=norms > 0), 9)
    return sorted(range(len(m)), key=lambda i: (-s[i], i))[:k]


def test_search_is_exact(spark, monkeypatch):
    m, df = vectors_of(spark)
    qs = m[[0, 3, 5]] + 0.01
    queries = spark.createDataFrame([(f"q{i}", q.tolist()) for i, q in enumerate(qs)], "query_id string, query_vector array<double>")
    want = {f"q{i}": top_by_hand(m, q, 12) for i, q in enumerate(qs)}
    for block in (4096, 2):
        monkeypatch.setattr(ve, "QUERY_BLOCK", block)
        rows = ve.search_many(df.repartition(5), queries, 12).orderBy("query_id", "rank").collect()
        assert {q: [r.vec_id for r in rows if r.query_id == q] for q in want} == want
    assert [r.vec_id for r in ve.search(df, qs[1].tolist(), 12).collect()] == want["q1"]
    assert ve.search_many(df, queries.where("false"), 3).count() == 0


def test_vector_columns(one, spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    r = df.select(vf.norm(F.col("a")), vf.l2_normalize(F.col("a")), vf.cosine_similarity(F.col("a"), F.col("z")), vf.has_dimension(F.col("a"), 2)).first()
    assert r[0] == 5.0 and r[1] == [0.6, 0.8] and r[2] is None and r[3] is True
    assert one(lambda: vf.similarity_from_distance(F.lit(None).cast("double"))) == 0.0
    assert one(lambda: vf.similarity_from_distance(F.lit(0.25))) == 0.75


def test_add_chunks_uses_given_vectors_only_when_all_have_one(spark):
    cols = "id string, content string, content_hash string, embedding array<double>"
    stored = spark.createDataFrame([("old",)], "content_hash string")
    mixed = spark.createDataFrame([("a", "x y", "h1", [9.0]), ("b", "x", "h2", None), ("c", "z", "old", None)], cols)
    out = {r.id: r.embedding for r in ve.add_chunks(mixed, stored, ve.hashing_embedder(8)).collect()}
    assert set(out) == {"a", "b"} and all(len(v) == 8 for v in out.values())
    given = mixed.where("id = 'a'")
    assert ve.add_chunks(given, stored).first().embedding == [9.0]
    twice = given.unionByName(given)
    assert ve.missing_chunks(twice, stored).count() == 2


def test_delete_by_filename(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "filename string, n int")
    left, count = ve.delete_by_filename(df, "a")
    assert [r.n for r in left.collect()] == [3] and count.first().deleted == 2


def test_rerank_order_and_zero_top_n(spark):
    rows = [("q", i, "x", d) for i, d in enumerate(["d1", "d9", "d5", "d5"])]
    df = spark.createDataFrame(rows, "query_id string, index int, query_text string, document string")
    scorer = rt.scorer_udf(lambda pairs: [int(d[1:]) / 10 for _, d in pairs])
    got = rt.rerank(df, 2, scorer).orderBy("rerank").collect()
    assert [r["index"] for r in got] == [1, 2] and got[0].relevance_score == 0.9
    for everything in (0, None):
        assert [r["index"] for r in rt.rerank(df, everything, scorer).orderBy("rerank").collect()] == [1, 2, 3, 0]
    assert rt.rerank(df.where("false"), 2, scorer).count() == 0


def test_fusion_and_budgets(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, rank int")
    b = spark.createDataFrame([("q", "y", 1)], "query_id string, chunk_id string, rank int")
    got = {r.chunk_id: r.rrf_score for r in rt.reciprocal_rank_fusion(a, b).collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)
    assert rt.entity_budget() == 2000 and rt.relation_budget() == 2666 and rt.entity_budget() + rt.relation_budget() < rt.CONTEXT_BUDGET
    docs = spark.createDataFrame([("q", i, "t" * n) for i, n in enumerate([40, 40, 400, 4])], "query_id string, rerank int, document string")
    assert [r.rerank for r in rt.within_budget(docs, 20, "document", "rerank").collect()] == [0, 1]


def test_knowledge_budget_over_many_rows(spark):
    rows = spark.range(5000).select(F.lit("q").alias("query_id"), F.col("id").alias("n"), F.lit("abc").alias("d"))
    got = rt.knowledge_within_budget(rows, 100, "d", [F.col("n")])
    assert sorted(r.n for r in got.collect()) == list(range(100))


def test_references_and_context(spark):
    ctx = spark.createDataFrame([("q", 1, "b", "two", "?"), ("q", 2, "a", "one", "?"), ("q", 3, "b", "three", "?")], "query_id string, rerank int, file_path string, document string, query_text string")
    assert [(r.reference_id, r.file_path) for r in rt.references(ctx).orderBy("reference_id").collect()] == [("1", "b"), ("2", "a")]
    assert rt.assemble_context(ctx).first().prompt.startswith("Context:\ntwo\n\none\n\nthree\n\nQuestion: ?")


def test_related_texts_with_a_hot_entity(spark):
    rng = random.Random(3)
    chunks = [(f"c{i:03d}", f"text {rng.randrange(60):02d}") for i in range(200)] + [("solo", "alone")]
    mentions = [("hot", c) for c, _ in chunks[:150]] + [(f"e{i % 40}", c) for i, (c, _) in enumerate(chunks[:200])]
    text = dict(chunks)
    by_key = {}
    for k, c in mentions:
        by_key.setdefault(k, set()).add(c)
    want = {
        c: sorted({text[o] for k, m in mentions if m == c for o in by_key[k] if o != c})[:3] for c, _ in chunks
    }
    got = rt.related_by_entity(
        spark.createDataFrame([(c,) for c, _ in chunks], "chunk_id string"),
        spark.createDataFrame(mentions, "key string, chunk_id string"),
        spark.createDataFrame(chunks, "chunk_id string, content string"),
    )
    assert {r.chunk_id: r.related_context for r in got.collect()} == want
