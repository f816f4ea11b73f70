"""Vector queries over `embeddings`, and pair scoring over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorefield.catalog.sqlparts import words
from lorefield.functions import vectors as vf
from lorefield.operators import retrieve as rt
from lorefield.operators import vector as ve
from lorefield.operators import vector_index as vi
from lorefield.operators.skew import lookup_join
from lorefield.session import apply_semantics, shared_folder, table

QUERIES = {}
ORACLES = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _embeddings(spark, base):
    apply_semantics(spark)
    return table(spark, base, "embeddings", "vec_id", "embedding", "label")


def _centroids(spark, base):
    """Mean vector of every label: (query_id, query_vector)."""
    flat = _embeddings(spark, base).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = flat.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    # One entry per vector dimension, so the collected list has the length of a vector.
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("query_vector")
    )


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_CENTROIDS = """
flat AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM v),
mean AS (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL),
q AS (SELECT label AS query_id, list(x ORDER BY pos) AS qv FROM mean GROUP BY label)"""
_TOPK = """
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(e, qv), 9) AS score FROM v, q),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""


@query(f"WITH {_VEC},{_CENTROIDS},{_TOPK} SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def vector_topk_by_label(spark, base):
    found = ve.search_many(_embeddings(spark, base), _centroids(spark, base), 10)
    return found.withColumn("score", F.round("score", 6))


@query(ORACLES["vector_topk_by_label"])
def vector_index_topk(spark, base):
    """The same search over a stored index, which opens only cells that can hold one of the best."""
    index = vi.create_index(_embeddings(spark, base), shared_folder(spark, "index"), dim=64)
    found = vi.search_index(index, _centroids(spark, base), 10)
    return found.withColumn("score", F.round("score", 6))


PROBE = [1.0 / (i + 1) for i in range(64)]


@query(
    f"""WITH {_VEC}, s AS (SELECT vec_id, round(list_cosine_similarity(e, [{', '.join(f'CAST({x!r} AS DOUBLE)' for x in PROBE)}]), 9) AS score FROM v)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10"""
)
def vector_search_single(spark, base):
    found = ve.search(_embeddings(spark, base), PROBE, 10)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {_VEC} SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, len(e) = 64 AS fits, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_unit,
       round(1 - coalesce(CASE WHEN label <> 3 THEN 1 - e[1] END, 1), 6) AS similarity FROM v"""
)
def vector_checks(spark, base):
    vecs = _embeddings(spark, base)
    e = F.col("embedding")
    first = F.element_at(e, 1).cast("double")
    return vecs.select(
        "vec_id",
        F.round(vf.norm(e), 6).alias("norm"),
        vf.has_dimension(e, 64).alias("fits"),
        F.round(F.element_at(vf.l2_normalize(e), 1), 6).alias("first_unit"),
        F.round(vf.similarity_from_distance(F.when(F.col("label") != 3, 1 - first)), 6).alias("similarity"),
    )


@query(
    f"""WITH {_VEC},{_CENTROIDS},{_TOPK},
a AS (SELECT query_id, vec_id, rank FROM top WHERE rank <= 40),
b AS (SELECT label AS query_id, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM v QUALIFY rank <= 40),
f AS (SELECT query_id, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS rrf_score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, vec_id, round(rrf_score, 9) AS rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f.rrf_score DESC, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 10"""
)
def rank_fusion(spark, base):
    """Similarity to the label's mean vector fused with recency inside the label."""
    vecs = _embeddings(spark, base)
    similar = ve.search_many(vecs, _centroids(spark, base), 40)
    recent = rt.top_per_query(
        vecs.select(F.col("label").alias("query_id"), "vec_id", F.col("vec_id").alias("age")), "age", 40, tie="vec_id"
    )
    fused = rt.reciprocal_rank_fusion(similar, recent, by=("query_id", "vec_id"))
    return rt.top_per_query(fused, "rrf_score", 10, tie="vec_id").select(
        "query_id", "vec_id", F.round("rrf_score", 9).alias("rrf_score"), "rank"
    )


@query(
    f"""WITH turns AS (
  SELECT conv_id AS query_id, turn AS index, text AS document, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS query_text FROM conversations),
scored AS (SELECT *, list_distinct({words('lower(query_text)')}) AS qt, list_distinct({words('lower(document)')}) AS dt FROM turns),
s2 AS (SELECT query_id, index, coalesce(len(list_intersect(qt, dt)) / nullif(CAST(len(qt) AS DOUBLE), 0), 0) AS score FROM scored)
SELECT query_id, index, round(score, 6) AS relevance_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, index) AS INTEGER) AS rerank FROM s2 QUALIFY rerank <= 2"""
)
def conversation_rerank(spark, base):
    """Turns of a conversation ranked by overlap with its first message; equal scores keep turn order."""
    turns = table(spark, base, "conversations", "conv_id", "turn", "text")
    opening = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("query_text"), F.count(F.lit(1)).alias("n"))
    pairs = lookup_join(turns, opening, "conv_id", "n", "turn", how="inner").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("index"), "query_text", F.col("text").alias("document")
    )
    ranked = rt.rerank(pairs, 2)
    return ranked.select("query_id", "index", F.round("relevance_score", 6).alias("relevance_score"), "rerank")


_CELL = "md5(CAST(label AS VARCHAR) || '/' || CAST(CAST(floor(e[1] * 10) AS INTEGER) AS VARCHAR))"


@query(
    f"""WITH {_VEC}, h AS (SELECT vec_id, label, {_CELL} AS content_hash FROM v),
stored AS (SELECT content_hash FROM h WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT vec_id, label, content_hash FROM h WHERE content_hash NOT IN (SELECT content_hash FROM stored)"""
)
def vector_new_chunks(spark, base):
    """Vectors whose hash is not stored yet; those of toxic documents count as stored."""
    first = F.floor(F.element_at("embedding", 1).cast("double") * 10).cast("int").cast("string")
    vecs = _embeddings(spark, base).withColumn("content_hash", F.md5(F.concat_ws("/", F.col("label").cast("string"), first)))
    toxic = table(spark, base, "labels", "doc_id", "toxic").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    stored = vecs.join(toxic, "vec_id", "left_semi")
    return ve.add_chunks(vecs, stored).select("vec_id", "label", "content_hash")
