"""Ingest: resolve duplicates first, then chunk, embed and extract only what is new."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.functions.text import casefold
from lorefield.operators import chunks as ch
from lorefield.operators import extract as ex
from lorefield.operators import graph as gr
from lorefield.operators import manifest as mf
from lorefield.operators import tokens as tk
from lorefield.operators import vector as ve
from lorefield.session import checkpointed


@dataclass(frozen=True)
class IndexOptions:
    """Chunk sizes and the models; without models the offline defaults are used, and without a vocabulary words are tokens."""

    size: int = ch.CHUNK_TOKENS
    overlap: int = ch.CHUNK_OVERLAP_TOKENS
    embedder: ve.Embedder | None = None
    predictor: ex.Predictor | None = None
    threshold: float | None = ex.SCORE_THRESHOLD
    vocabulary: tk.Vocabulary | None = None


def index(documents: DataFrame, options: IndexOptions = IndexOptions()) -> dict[str, DataFrame]:
    """Tables of indexed documents (doc_id, text): chunks, vectors, mentions, pairs, entities, edges and links.

    The extracted records are made durable once, since five tables are read from them.
    """
    if options.vocabulary:
        chunks = tk.chunk_by_vocabulary(documents, options.vocabulary, size=options.size, overlap=options.overlap).drop("token_start", "first", "last")
    else:
        chunks = ch.chunk_by_tokens(documents, size=options.size, overlap=options.overlap)
    records = checkpointed(ex.extract_records(chunks, predictor=options.predictor, threshold=options.threshold))
    mentions = ex.entity_rows(records, "doc_id", "chunk_index", "chunk_id").withColumn("key", casefold(F.col("name")))
    pairs = ex.relationship_rows(records, "doc_id", "chunk_index").withColumns(
        {"source_key": casefold(F.col("source")), "target_key": casefold(F.col("target"))}
    )
    stored = ch.with_chunk_facts(records.select("doc_id", "chunk_index", "chunk_id", "content", "token_count"))
    return {
        "chunks": stored,
        "vectors": ve.embed(records.select("chunk_id", "content"), embedder=options.embedder).select("chunk_id", "embedding"),
        "mentions": mentions,
        "pairs": pairs,
        "entities": gr.merge_mentions(mentions),
        "edges": gr.merge_pairs(pairs),
        "links": gr.entity_links(mentions),
    }


def ingest(incoming: DataFrame, manifest: DataFrame, date_added: Column, options: IndexOptions = IndexOptions()) -> dict[str, DataFrame]:
    """Outcome of one batch plus the index tables and manifest rows of its new documents.

    `incoming`: (seq, file_name, source_type, text), optionally with `error` from the parsers. Duplicates never reach
    the chunker: the anti join comes before every costly step. The texts are scanned once for their hashes and once to
    be chunked, which is cheaper than writing them again; store `incoming` first when parsing it is expensive.
    """
    parsed_error = F.col("error") if "error" in incoming.columns else F.lit(None).cast("string")
    staged = mf.prepare(incoming.withColumn("_parsed", parsed_error)).withColumn("error", F.coalesce("_parsed", "error"))
    prepared = staged.drop("_parsed")
    outcomes = checkpointed(mf.resolve_batch(prepared, manifest))
    fresh = mf.fresh_documents(prepared, outcomes)
    tables = index(fresh.select("doc_id", "text"), options)
    counted = ch.chunk_counts(fresh.drop("text"), tables["chunks"])
    tables["manifest"] = mf.manifest_rows(counted, date_added)
    tables["results"] = outcomes
    tables["errors"] = prepared.where(F.col("error").isNotNull()).select("seq", "file_name", "error")
    return tables


def resume(status: DataFrame, texts: DataFrame, options: IndexOptions = IndexOptions()) -> dict[str, DataFrame]:
    """Index again what is pending, processing or failed. Explicit: nothing resumes by itself. `texts`: (doc_id, text)."""
    wanted = mf.resumable(status).select(F.col("id").alias("doc_id"))
    return index(texts.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), options)


def append_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Append every table below a folder. Merged entities and edges are derived, so they are rebuilt from the rows."""
    for name in ("chunks", "vectors", "mentions", "pairs", "manifest"):
        if name in tables:
            tables[name].write.mode("append").parquet(f"{base}/{name}")
