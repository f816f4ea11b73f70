"""Hybrid question answering up to the assembled context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorefield.functions.text import casefold
from lorefield.operators import extract as ex
from lorefield.operators import retrieve as rt
from lorefield.operators import vector as ve
from lorefield.session import checkpointed


@dataclass(frozen=True)
class AskOptions:
    """Settings of one retrieval. The entity and relation budgets follow from the one total."""

    candidates: int = rt.CANDIDATES
    top_n: int = rt.RERANK_TOP_N
    budget: int = rt.CONTEXT_BUDGET
    embedder: ve.Embedder | None = None
    predictor: ex.Predictor | None = None


def query_entities(questions: DataFrame, options: AskOptions = AskOptions()) -> DataFrame:
    """(query_id, key) of the entities a question names."""
    found = ex.extract_records(questions.select("query_id", "query_text"), "query_text", options.predictor)
    rows = ex.entity_rows(found, "query_id").select("query_id", casefold(F.col("name")).alias("key"))
    # Joined several times: as a stored table it is computed once and its size is known.
    return checkpointed(rows.distinct())


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, mentions: DataFrame, edges: DataFrame, options: AskOptions = AskOptions()) -> DataFrame:
    """Vector hits and graph hits fused, reranked and cut to the token budget.

    `questions`: (query_id, query_text); `chunks`: (chunk_id, content, ...); `vectors`: (chunk_id, embedding);
    `mentions`: (key, chunk_id); `edges`: (src, dst). The scorer sees `candidates` pairs per question, never all.
    """
    embedded = ve.embed(questions, "query_text", "query_vector", options.embedder)
    by_vector = ve.search_many(vectors, embedded, options.candidates, id_col="chunk_id")
    by_graph = rt.top_per_query(rt.graph_hits(query_entities(questions, options), edges, mentions), "matched", options.candidates)
    fused = rt.reciprocal_rank_fusion(by_vector, by_graph)
    pool = rt.top_per_query(fused, "rrf_score", options.candidates, rank="index")
    pairs = pool.join(questions, "query_id").join(chunks.withColumnRenamed("content", "document"), "chunk_id")
    best = rt.rerank(pairs, options.top_n)
    return rt.within_budget(best, options.budget, "document", "rerank")


def knowledge(questions: DataFrame, entities: DataFrame, edges: DataFrame, options: AskOptions = AskOptions()) -> tuple[DataFrame, DataFrame]:
    """Entity and relation rows around each question, each under its own budget.

    `entities`: (key, name, entity_type, description, mentions); `edges`: (src, dst, weight, keywords, description).
    """
    keys, touching = rt.query_neighborhood(query_entities(questions, options), edges)
    found = keys.join(entities, "key")
    shown_entities = rt.knowledge_within_budget(
        found, rt.entity_budget(options.budget), "description", [F.desc("mentions"), F.col("key")]
    )
    shown_edges = rt.knowledge_within_budget(
        touching, rt.relation_budget(options.budget), "description", [F.desc("weight"), F.col("src"), F.col("dst")]
    )
    return shown_entities, shown_edges
