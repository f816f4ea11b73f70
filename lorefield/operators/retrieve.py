"""Hybrid retrieval: rank fusion, second-pass ranking, token budgets, references and context."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.text import count_tokens
from lorefield.operators.skew import lookup_join
from lorefield.operators.vector import overlap_score
from lorefield.session import checkpointed

# --- fixed values ---
RRF_K = 60
CANDIDATES = 40
RERANK_TOP_N = 10
CONTEXT_BUDGET = 8000
RELATED_TEXTS = 3
CONTEXT_TEMPLATE = "Context:\n%s\n\nQuestion: %s\n\nAnswer using only the context above. Cite sources by URL."
# --------------------


def entity_budget(total: int = CONTEXT_BUDGET) -> int:
    return total // 4


def relation_budget(total: int = CONTEXT_BUDGET) -> int:
    return total // 3


def reciprocal_rank_fusion(*ranked: DataFrame, by: tuple[str, str] = ("query_id", "chunk_id"), k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank) over several rankings of (query_id, chunk_id, rank)."""
    every = ranked[0].select(*by, "rank")
    for other in ranked[1:]:
        every = every.unionByName(other.select(*by, "rank"))
    return every.groupBy(*by).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 12).alias("rrf_score"))


def top_per_query(df: DataFrame, score: str, n: int, query_id: str = "query_id", tie: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """Best n per query; Spark drops rows beyond n in each task before the shuffle."""
    order = Window.partitionBy(query_id).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= n)


def scorer_udf(score: Callable[[list[tuple[str, str]]], list[float]]):
    """Pair scorer contract: (query, document) pairs in, scores out, one call per Arrow batch."""

    @F.pandas_udf(T.DoubleType())
    def run(query: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(query, document))), dtype="float64")

    return run


def rerank(candidates: DataFrame, top_n: int | None = RERANK_TOP_N, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """Score (query, document) pairs and keep the best; equal scores keep their input order `index`.

    `candidates`: (query_id, index, query_text, document). A missing or zero `top_n` keeps all.
    """
    scored = candidates.withColumn("relevance_score", scorer(F.col("query_text"), F.col("document")))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "index")
    ranked = scored.withColumn("rerank", F.row_number().over(order))
    return ranked.where(F.col("rerank") <= top_n) if top_n else ranked


def within_budget(ranked: DataFrame, budget: int, text: str, order: str, query_id: str = "query_id") -> DataFrame:
    """Leading rows of every query whose running token sum stays within the budget. Input is already cut to top n."""
    upto = Window.partitionBy(query_id).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranked.withColumn("tokens", count_tokens(F.col(text)))
        .withColumn("tokens_used", F.sum("tokens").over(upto))
        .where(F.col("tokens_used") <= budget)
    )


def references(context: DataFrame, order: str = "rerank", file_path: str = "file_path") -> DataFrame:
    """Distinct files of the context in order of first use, numbered from 1."""
    firsts = context.groupBy("query_id", file_path).agg(F.min(order).alias("_at"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("_at", file_path))
    return firsts.select("query_id", number.cast("string").alias("reference_id"), F.col(file_path).alias("file_path"))


def assemble_context(context: DataFrame, question: str = "query_text", text: str = "document", order: str = "rerank") -> DataFrame:
    """One prompt per query from its few budgeted chunks, joined by blank lines in rank order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    body = F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n")
    return context.groupBy("query_id").agg(
        F.format_string(CONTEXT_TEMPLATE, body, F.first(question)).alias("prompt"), F.count(F.lit(1)).alias("chunks")
    )


def related_by_entity(hits: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = RELATED_TEXTS) -> DataFrame:
    """Optional expansion: up to `limit` smallest distinct texts of other chunks that name an entity of the hit.

    `hits`: (chunk_id, ...); `mentions`: (key, chunk_id); `chunks`: (chunk_id, content). Hits without entities stay,
    with an empty list. Per entity only the smallest `limit` + 1 texts can ever be shown (one may be the hit's own),
    so no more are kept and a very common entity costs no more than a rare one. Texts are sorted once and joined last.
    """
    named = mentions.select("key", "chunk_id").distinct()
    own = checkpointed(named.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    wanted = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hashed = chunks.select("chunk_id", F.sha2("content", 256).alias("text_hash"))
    holders = hashed.groupBy("text_hash").agg(F.min("chunk_id").alias("holder"))
    # Sorting the distinct texts once numbers them in text order; all joins below carry numbers only.
    sorted_texts = chunks.select("chunk_id", "content").join(holders, F.col("chunk_id") == F.col("holder"), "left_semi").orderBy("content")
    texts = checkpointed(sorted_texts.select(F.monotonically_increasing_id().alias("text_no"), "chunk_id", "content"))
    numbers = hashed.join(holders, "text_hash").join(texts.select(F.col("chunk_id").alias("holder"), "text_no"), "holder").select("chunk_id", "text_no")
    places = named.join(wanted.select("key"), "key", "left_semi").join(numbers, "chunk_id")
    per_text = places.groupBy("key", "text_no").agg(F.min("chunk_id").alias("lo"), F.max("chunk_id").alias("hi"))
    smallest = per_text.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("text_no"))).where(F.col("r") <= limit + 1)
    lookup = smallest.groupBy("key").agg(F.collect_list(F.struct("text_no", "lo", "hi")).alias("few")).join(wanted, "key")
    candidates = lookup_join(own, lookup, "key", "n", "chunk_id", how="inner").select("chunk_id", F.explode("few").alias("t"))
    only_itself = (F.col("t.lo") == F.col("chunk_id")) & (F.col("t.hi") == F.col("chunk_id"))
    # At most (entities of one chunk) x (limit + 1) numbers.
    few = candidates.where(~only_itself).groupBy("chunk_id").agg(F.slice(F.array_sort(F.collect_set("t.text_no")), 1, limit).alias("few"))
    shown = few.select("chunk_id", F.explode("few").alias("text_no")).join(texts.select("text_no", "content"), "text_no")
    lists = shown.groupBy("chunk_id").agg(F.array_sort(F.collect_list("content")).alias("related_context"))
    return hits.join(lists, "chunk_id", "left").withColumn(
        "related_context", F.coalesce("related_context", F.expr("cast(array() as array<string>)"))
    )


def graph_hits(query_entities: DataFrame, edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks naming a query entity or a 1-hop neighbour: (query_id, chunk_id, matched), matched = entities found.

    `query_entities`: (query_id, key). Counting combines before the shuffle, so common entities stay cheap.
    """
    # Stored, so that the join sees its size, and can split the rows of a common entity when it does not broadcast.
    wanted = checkpointed(query_neighborhood(query_entities, edges)[0])
    links = mentions.select("key", "chunk_id").distinct()
    return links.join(wanted, "key").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("matched"))


def query_neighborhood(query_entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, edges) around the query entities: each entity and its 1-hop neighbours, and the edges that lead there."""
    seeds = query_entities.select("query_id", "key").distinct()
    out = seeds.join(edges.withColumn("key", F.col("src")), "key")
    back = seeds.join(edges.withColumn("key", F.col("dst")), "key")
    touching = out.drop("key").unionByName(back.drop("key")).dropDuplicates(["query_id", "src", "dst"])
    ends = touching.select("query_id", F.explode(F.array("src", "dst")).alias("key"))
    return seeds.unionByName(ends).distinct(), touching


def knowledge_within_budget(ranked: DataFrame, budget: int, text: str, order: list, query_id: str = "query_id") -> DataFrame:
    """Leading knowledge rows of every query within the budget; each row also costs one token for its line break.

    At most `budget` rows can fit, so rows ranked beyond that are dropped before the running sum without changing it.
    """
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(*order))
    possible = ranked.withColumn("place", place).where(F.col("place") <= budget)
    upto = Window.partitionBy(query_id).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        possible.withColumn("tokens", F.coalesce(count_tokens(F.col(text)), F.lit(0)) + 1)
        .withColumn("tokens_used", F.sum("tokens").over(upto))
        .where(F.col("tokens_used") <= budget)
    )
