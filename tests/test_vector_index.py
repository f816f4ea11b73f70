"""The stored index against plain cosine search."""

import numpy as np
import pytest

from lorefield.operators import vector_index as vi
from lorefield.session import shared_folder

COLUMNS = "vec_id long, embedding array<float>"


def clustered(seed, groups=12, size=40, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(int(g * size + i), (centres[g] + rng.normal(scale=0.1, size=dim)).astype("float32").tolist()) for g in range(groups) for i in range(size)]


def by_hand(rows, queries, k):
    unit = lambda v: np.array(v, "float32").astype(float) / (np.linalg.norm(np.array(v, "float32").astype(float)) or 1)
    out = {}
    for q, v in queries:
        scored = sorted((-(round(float(unit(x) @ unit(v)), 9) + 0.0), i) for i, x in rows)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_exact_and_reads_a_part(spark, monkeypatch):
    monkeypatch.setattr(vi, "PART_ROWS", 16)
    monkeypatch.setattr(vi, "QUERY_BLOCK", 4)
    rows = clustered(1)
    index = vi.create_index(spark.createDataFrame(rows, COLUMNS).repartition(5), shared_folder(spark, "index"), 16)
    assert index.size == len(rows) and len(index.centres) == 21
    queries = rows[::7] + [(9000, (-np.array(rows[3][1])).tolist())]
    report = vi.SearchReport()
    got = found(vi.search_index(index, spark.createDataFrame(queries, "query_id long, query_vector array<float>"), 5, report=report))
    same(got, by_hand(rows, queries, 5))
    assert report.pairs < 0.5 * len(rows) * len(queries)


def test_one_query_opens_few_rows(spark):
    rows = clustered(2)
    index = vi.create_index(spark.createDataFrame(rows, COLUMNS), shared_folder(spark, "index"), 16)
    report = vi.SearchReport()
    query = spark.createDataFrame([("q", rows[5][1])], "query_id string, query_vector array<float>")
    same(found(vi.search_index(index, query, 3, report=report)), by_hand(rows, [("q", rows[5][1])], 3))
    assert sum(report.opened) < 0.5 * len(rows)


def test_ties_zero_vectors_nulls_and_odd_rows(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(100 + i, [0.0] * 4) for i in range(5)] + [(200, [-1.0, 0.0, 0.0, 0.0]), (201, [0.0, 1.0, 0.0, 0.0])]
    odd = [(300, None), (301, [1.0]), (302, [1.0, None, 0.0, 0.0])]
    index = vi.create_index(spark.createDataFrame(rows + odd, COLUMNS), shared_folder(spark, "index"), 4, cells=3)
    assert index.size == len(rows)
    queries = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0] * 4), (3, [0.0, 0.0, 1.0, 0.0]), (4, [-2.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(queries + [(5, [1.0]), (6, None)], "query_id long, query_vector array<float>")
    same(found(vi.search_index(index, frame, 45)), by_hand(rows, queries, 45))
    assert vi.search_index(index, frame.limit(0), 3).count() == 0


def test_more_rows_reopened_and_written_twice(spark):
    rows, path = clustered(3), shared_folder(spark, "index")
    index = vi.create_index(spark.createDataFrame(rows[:300], COLUMNS), path, 16)
    for _ in range(2):
        index = vi.add_vectors(index, spark.createDataFrame(rows[300:], COLUMNS), "second")
    again = vi.create_index(spark.createDataFrame([], COLUMNS), path, 16)
    assert again.size == index.size == len(rows) and again.batches == ("first", "second")
    queries = rows[::31]
    same(found(vi.search_index(again, spark.createDataFrame(queries, "query_id long, query_vector array<float>"), 4)), by_hand(rows, queries, 4))


def test_a_batch_without_statistics_is_not_read(spark):
    rows, path = clustered(4), shared_folder(spark, "index")
    index = vi.create_index(spark.createDataFrame(rows[:100], COLUMNS), path, 16)
    index.rows().withColumn("batch", vi.F.lit("died")).write.mode("append").partitionBy("batch", "cell").parquet(f"{path}/rows")
    assert vi.open_index(spark, path).rows().count() == 100


def test_an_empty_index(spark):
    index = vi.create_index(spark.createDataFrame([], COLUMNS), shared_folder(spark, "index"), 4)
    assert index.size == 0
    assert vi.search_index(index, spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, query_vector array<float>")).count() == 0
