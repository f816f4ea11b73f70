"""A stored knowledge base: batches go in, documents go out, and a step that runs again changes nothing.

All tables change in one snapshot (`snapshots.Tables`): a job that dies, wherever it does, leaves the base as it was, so a
document is either in every table or in none. Tables are dealt by the key that changes ask for: documents' rows by document,
mentions and pairs by what they are merged into. A batch adds runs of rows, and rewrites of the merged entities and edges only
the parts whose keys it names; a deletion rewrites only parts that hold rows of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.operators import graph as gr
from lorefield.operators import manifest as mf
from lorefield.operators import vector as ve
from lorefield.plans.ingest import IndexOptions, ingest
from lorefield.plans.snapshots import PARTS, Change, Tables
from lorefield.schemas import DOC_STATUS, MANIFEST
from lorefield.session import checkpointed

PLACE = "doc_id string, chunk_index int"
SCHEMAS = {
    "chunks": f"{PLACE}, chunk_id string, content string, token_count int, char_count int, content_hash string",
    "vectors": "doc_id string, chunk_id string, embedding array<float>",
    "mentions": f"{PLACE}, chunk_id string, pos int, name string, type string, description string, key string",
    "pairs": f"{PLACE}, pos int, source string, target string, keywords string, description string, source_key string, target_key string, src string, dst string",
    "status": DOC_STATUS,
    "manifest": MANIFEST,
    "entities": "key string, entity_type string, name string, mentions long, description string",
    "edges": "src string, dst string, weight double, keywords string, description string",
    # Which merged rows a document has a share in.
    "document_keys": "doc_id string, key string",
    "document_ends": "doc_id string, src string, dst string",
}
KEYS = {
    "chunks": ["doc_id"], "vectors": ["doc_id"], "status": ["id"], "manifest": ["doc_id"], "document_keys": ["doc_id"], "document_ends": ["doc_id"],
    "mentions": ["key"], "entities": ["key"], "pairs": ["src", "dst"], "edges": ["src", "dst"],
}


class Store(Tables):
    """The tables of one knowledge base; a table without rows reads as empty."""

    def __init__(self, spark: SparkSession, base: str, parts: int = PARTS):
        super().__init__(spark, base, SCHEMAS, KEYS, parts)


def _with_ends(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"src": F.least("source_key", "target_key"), "dst": F.greatest("source_key", "target_key")})


def _merge_again(change: Change, keys: DataFrame, ends: DataFrame) -> None:
    """Entities of `keys` (key) and edges of `ends` (src, dst) from all their mentions and pairs. Only the parts that hold one of
    them are read and written again."""
    tables = change.tables
    for name, rows, wanted, merge in (("entities", "mentions", keys, gr.merge_mentions), ("edges", "pairs", ends, gr.merge_pairs)):
        by = KEYS[name]
        # Rows of a key and its merged row have the same part number.
        parts = tables.parts_in(name, wanted)
        if not parts:
            continue
        named = change.load(rows, parts)
        if not change.holds(name, parts):
            # Nothing merged there yet, so every key there is one of the wanted.
            change.rewrite(name, merge(named), parts)
            continue
        merged = tables.shaped(merge(named.join(wanted, by, "left_semi")), name)
        change.rewrite(name, change.load(name, parts).join(wanted, by, "left_anti").unionByName(merged), parts)


def add_batch(store: Store, incoming: DataFrame, date_added: Column, options: IndexOptions = IndexOptions(), track_id: str | None = None) -> dict[str, DataFrame]:
    """Ingest one batch (seq, file_name, source_type, text) and store it; gives `results` and `errors`.

    Known contents lead to the stored document. Of new contents, one whose file name the index already holds, or an
    earlier row of the batch has, is refused: it leads to the document of that name. Running a batch again stores nothing.
    """
    change = store.begin()
    manifest, status = change.load("manifest"), change.load("status")
    taken = status.where(F.col("status") == "processed").select(F.col("file_path").alias("file_name")).distinct()
    hashed = checkpointed(mf.prepare(incoming).where(F.col("error").isNull()).select("seq", "file_name", "content_hash"))
    fresh = hashed.groupBy("content_hash").agg(F.min_by(F.struct("seq", "file_name"), "seq").alias("f")).select("content_hash", "f.*")
    fresh = fresh.join(manifest.select("content_hash"), "content_hash", "left_anti")
    first = fresh.groupBy("file_name").agg(F.min("seq").alias("first"))
    named = fresh.join(taken.withColumn("taken", F.lit(True)), "file_name", "left").join(first, "file_name")
    refused = checkpointed(named.where(F.col("taken").isNotNull() | (F.col("seq") > F.col("first"))).select("content_hash", "file_name"))
    rejected = hashed.join(refused.select("content_hash"), "content_hash", "left_semi").select("seq", "file_name")
    out = ingest(incoming.join(rejected.select("seq"), "seq", "left_anti"), manifest, date_added, options)
    indexed = checkpointed(out["manifest"])
    if not indexed.isEmpty():
        # These are read off the stored records; writing them once more before they are dealt into parts would gain nothing.
        chunks, mentions, pairs = out["chunks"], out["mentions"], _with_ends(out["pairs"])
        keys, ends = checkpointed(mentions.select("doc_id", "key").distinct()), checkpointed(pairs.select("doc_id", "src", "dst").distinct())
        vectors = ve.embed(chunks.select("doc_id", "chunk_id", "content"), embedder=options.embedder)
        rows = indexed.select(
            F.col("doc_id").alias("id"),
            F.lit(track_id).cast("string").alias("track_id"),
            F.lit("processed").alias("status"),
            F.col("file_name").alias("file_path"),
            F.col("chunk_count").alias("chunks_count"),
            F.md5("file_name").alias("content_hash"),
            F.col("size_bytes").alias("content_length"),
        )
        added = {"chunks": chunks, "vectors": vectors, "mentions": mentions, "pairs": pairs, "status": rows, "manifest": indexed, "document_keys": keys, "document_ends": ends}
        for name, new in added.items():
            change.append(name, new)
        _merge_again(change, keys.select("key").distinct(), ends.select("src", "dst").distinct())
    lost = checkpointed(mf.reconcile(change.load("status"), change.load("manifest"), date_added))
    if not lost.isEmpty():
        change.append("manifest", lost)
    if change.changed:
        change.commit()
    answers = mf.resolve_rejected(rejected, change.load("manifest"))
    results = out["results"].select("seq", "doc_id", "deduped").unionByName(answers.where("error IS NULL").select("seq", "doc_id", "deduped"))
    errors = out["errors"].unionByName(answers.where("error IS NOT NULL").select("seq", "file_name", "error"))
    return {"results": results, "errors": errors}


def remove_documents(store: Store, ids: DataFrame) -> DataFrame:
    """Delete documents (doc_id) from every table and take their share out of entities and edges; gives (doc_id, deleted)."""
    change = store.begin()
    out = mf.delete_documents(ids, change.load("manifest"), change.load("status"))
    outcome = checkpointed(out["outcome"])
    gone = checkpointed(outcome.where("deleted").select("doc_id"))
    if gone.isEmpty():
        return outcome
    parts = store.parts_in("manifest", gone)
    keys = checkpointed(change.load("document_keys", parts).join(gone, "doc_id", "left_semi").select("key").distinct())
    ends = checkpointed(change.load("document_ends", parts).join(gone, "doc_id", "left_semi").select("src", "dst").distinct())
    touched = {"mentions": store.parts_in("mentions", keys), "pairs": store.parts_in("pairs", ends)}
    for name in ("chunks", "vectors", "mentions", "pairs", "manifest", "document_keys", "document_ends"):
        own = touched.get(name, parts)
        if own:
            change.rewrite(name, change.load(name, own).join(gone, "doc_id", "left_anti"), own, in_place=True)
    # Status rows that go: those of the documents, and refused ones under their names.
    status = change.load("status")
    stale = checkpointed(status.select("id").join(out["status"].select("id"), "id", "left_anti"))
    own = store.parts_in("status", stale)
    if own:
        change.rewrite("status", change.load("status", own).join(stale, "id", "left_anti"), own, in_place=True)
    _merge_again(change, keys, ends)
    change.commit()
    return outcome
