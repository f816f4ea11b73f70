"""Exact vector search, embedding contracts and the hash-skipping insert."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.vectors import cosine_similarity, has_dimension
from lorefield.session import checkpointed

# --- fixed values ---
DEFAULT_TOP_K = 10
EMBEDDING_DIM = 384
# --------------------

# Scores are compared after rounding, so equal vectors tie whatever block they were multiplied in.
SCORE_DIGITS = 9
# Query vectors held by one task: 4096 x 384 doubles are 12 MB.
QUERY_BLOCK = 4096
# Texts of one model call.
EMBED_ROWS = 512

Embedder = Callable[[list[str]], np.ndarray]


def search(vectors: DataFrame, query: list[float], k: int = DEFAULT_TOP_K, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Top k by cosine for one query vector. The sort-and-limit keeps k rows per task before anything is moved."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    score = F.round(F.coalesce(cosine_similarity(F.col(vector), literal), F.lit(0.0)), SCORE_DIGITS)
    return vectors.withColumn("score", score).orderBy(F.desc("score"), id_col).limit(k)


def search_many(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_TOP_K,
    id_col: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """Top k vectors for every query: (query_id, vec_id, score, rank), exact.

    Each task multiplies its own vectors with a block of query vectors and keeps k candidates per query, so what is
    shuffled is k rows per query and task. More queries than fit one block are taken block by block.
    """
    queries = checkpointed(queries.select(query_id, query_vector))
    blocks = -(-queries.select(query_id).count() // QUERY_BLOCK)
    parts = []
    for number in range(max(blocks, 1)):
        block = queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == number)
        rows = block.select(query_id, query_vector).toPandas()
        if len(rows):
            parts.append(_search_block(vectors, rows, k, id_col, vector, queries.schema[query_id].dataType, query_id))
    id_type = vectors.schema[id_col].dataType
    if not parts:
        schema = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())])
        parts = [vectors.sparkSession.createDataFrame([], schema)]
    candidates = parts[0]
    for part in parts[1:]:
        candidates = candidates.unionByName(part)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(vectors: DataFrame, rows: pd.DataFrame, k: int, id_col: str, vector: str, query_type: T.DataType, query_id: str) -> DataFrame:
    matrix = _unit_rows(np.array(rows.iloc[:, 1].tolist(), dtype="float64"))
    names = rows.iloc[:, 0].tolist()
    shared = vectors.sparkSession.sparkContext.broadcast(matrix)
    id_type = vectors.schema[id_col].dataType

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        q = shared.value
        for batch in batches:
            if not len(batch):
                continue
            block = _unit_rows(np.stack(batch[vector].to_numpy()).astype("float64"))
            scores = np.round(block @ q.T, SCORE_DIGITS)
            ids = batch[id_col].to_numpy()
            keep = min(k, len(ids))
            # Order by score, then id, and take the first k of every query column.
            by_id = np.argsort(ids, kind="stable")
            ranked = by_id[np.argsort(-scores[by_id], axis=0, kind="stable")[:keep]]
            found = pd.DataFrame(
                {
                    "q": np.repeat(np.arange(q.shape[0]), keep),
                    "id": ids[ranked].T.ravel(),
                    "score": np.take_along_axis(scores, ranked, axis=0).T.ravel(),
                }
            )
            merged = found if best is None else pd.concat([best, found])
            best = merged.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
        if best is not None:
            yield pd.DataFrame({query_id: [names[i] for i in best["q"]], id_col: best["id"].to_numpy(), "score": best["score"].to_numpy() + 0.0})

    schema = T.StructType(
        [T.StructField(query_id, query_type), T.StructField(id_col, id_type), T.StructField("score", T.DoubleType())]
    )
    return vectors.select(id_col, vector).mapInPandas(run, schema)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.zeros_like(matrix), where=lengths > 0)


def token_bucket_of(token: str, dim: int) -> int:
    return int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def hashing_embedder(dim: int = EMBEDDING_DIM) -> Embedder:
    """Offline default: unit-length counts of hashed lower-case tokens."""

    def embed(texts: list[str]) -> np.ndarray:
        known: dict[str, int] = {}
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for token in text.lower().split():
                slot = known.get(token)
                if slot is None:
                    slot = known[token] = token_bucket_of(token, dim)
                out[row, slot] += 1
        return _unit_rows(out)

    return embed


def embed(df: DataFrame, text: str = "content", out: str = "embedding", embedder: Embedder | None = None) -> DataFrame:
    """Add vectors with one model call per EMBED_ROWS texts; the embedder is loaded once per Python worker."""
    model = embedder or hashing_embedder()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # A batch's vectors leave block by block: together they are many times larger than its texts.
        for batch in batches:
            for at in range(0, len(batch), EMBED_ROWS):
                yield pd.Series(list(model([t or "" for t in batch.iloc[at : at + EMBED_ROWS]])))

    return df.withColumn(out, run(F.col(text)))


def check_dimension(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vector has not the dimension the index was made for."""
    return vectors.where(~has_dimension(F.col(vector), dim))


def add_chunks(chunks: DataFrame, stored: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks whose content hash is not stored yet, with a vector each.

    Supplied vectors are used only when every new chunk has one; otherwise all are embedded anew. The new chunks are
    stored, so that the one-row test does not compute the anti join a second time.
    """
    fresh = checkpointed(missing_chunks(chunks, stored))
    complete = fresh.agg(F.coalesce(F.bool_and(F.col("embedding").isNotNull()), F.lit(True)).alias("all_given")).first()
    if complete["all_given"]:
        return fresh
    return embed(fresh.drop("embedding"), embedder=embedder)


def missing_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Anti join against the stored hashes only; equal chunks inside one batch stay, as each has its own id."""
    return chunks.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")


def delete_by_filename(chunks: DataFrame, filename: str) -> tuple[DataFrame, DataFrame]:
    """(remaining chunks, one-row count of the deleted ones)."""
    hit = F.col("filename") == filename
    return chunks.where(~hit), chunks.where(hit).agg(F.count(F.lit(1)).alias("deleted"))


def overlap_score(query: Column, document: Column) -> Column:
    """Offline pair scorer: share of the distinct query tokens found in the document."""
    from lorefield.functions.arrays import let
    from lorefield.functions.text import words

    def tokens(text: Column) -> Column:
        return F.array_distinct(words(F.lower(text)))

    return let(
        tokens(query),
        lambda q: F.coalesce(F.size(F.array_intersect(q, tokens(document))) / F.nullif(F.size(q), F.lit(0)), F.lit(0.0)),
    )
