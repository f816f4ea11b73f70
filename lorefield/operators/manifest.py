"""The document inventory: duplicate resolution, reconcile, listing, lookups and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.functions.text import content_hash, doc_id_from_hash, falsy, py_strip, utf8_size
from lorefield.operators.skew import lookup_join
from lorefield.schemas import MANIFEST
from lorefield.session import checkpointed

# --- fixed values ---
EXTENSION_TYPES = {".pdf": "pdf", ".md": "markdown", ".markdown": "markdown", ".txt": "text"}
UNKNOWN_TYPE = "unknown"
# Marks a hash that was not made from the text here, so it never equals a real content hash.
RECONCILED_HASH_PREFIX = "external-md5:"
TOMBSTONE_PREFIX = "dup-"
NO_CONTENT_ERROR = "No content to ingest."
REJECTED_HINT = (
    " was rejected as a duplicate, but no indexed document with that name exists. "
    "Delete it from the knowledge base and upload again."
)
RESUMABLE = ("pending", "processing", "failed")
# --------------------

ROW = ["doc_id", "file_name", "source_type", "content_hash", "chunk_count", "size_bytes", "date_added"]
API_ROW = [c for c in ROW if c != "content_hash"]


def extension(file_name: Column) -> Column:
    """Lower-case extension of the last path part; leading dots do not start one."""
    base = F.regexp_extract(file_name, r"([^/]*)\z", 1)
    return F.lower(F.regexp_extract(F.regexp_replace(base, r"^\.+", ""), r"(\.[^.]*)\z", 1))


def source_type_of(file_name: Column) -> Column:
    """Type by extension, null when the extension is not supported."""
    kinds = F.create_map(*[F.lit(x) for pair in EXTENSION_TYPES.items() for x in pair])
    return F.try_element_at(kinds, extension(file_name))


def prepare(incoming: DataFrame) -> DataFrame:
    """Add the stripped text's hash and size, and an error for blank text. Input: (seq, file_name, source_type, text)."""
    stripped = incoming.withColumn("text", py_strip(F.col("text")))
    return stripped.withColumns(
        {
            "content_hash": content_hash(F.col("text")),
            "size_bytes": utf8_size(F.col("text")),
            "error": F.when(F.coalesce(F.col("text"), F.lit("")) == "", F.lit(NO_CONTENT_ERROR)),
        }
    )


def pin_first(manifest: DataFrame, key: str) -> DataFrame:
    """One manifest row per key: the earliest, then the smallest id."""
    return (
        manifest.groupBy(key)
        .agg(F.min_by(F.struct(*[c for c in ROW if c != key]), F.struct("date_added", "doc_id")).alias("_row"))
        .select(key, "_row.*")
    )


def resolve_batch(prepared: DataFrame, manifest: DataFrame) -> DataFrame:
    """Outcome per incoming row, as if the rows arrived one by one in `seq` order.

    A row whose hash is known (in the manifest, or from an earlier row of the batch) gives the known document with
    deduped = true; otherwise it is new. The texts take no part in the join, only their hashes do.
    """
    usable = prepared.where(F.col("error").isNull())
    # Narrow rows, stored once: the texts are scanned and hashed a single time although the rows are read three times.
    light = checkpointed(usable.select("seq", "content_hash", "file_name", "source_type", "size_bytes"))
    winners = light.groupBy("content_hash").agg(
        F.min_by(F.struct("seq", "file_name", "source_type", "size_bytes"), "seq").alias("first"),
        F.count(F.lit(1)).alias("copies"),
    )
    known = pin_first(manifest, "content_hash").select(
        "content_hash", F.struct("doc_id", "file_name", "source_type", "size_bytes").alias("known")
    )
    decided = winners.join(known, "content_hash", "left").select(
        "content_hash",
        "copies",
        F.when(F.col("known").isNull(), F.col("first.seq")).alias("new_seq"),
        F.coalesce(F.col("known.doc_id"), doc_id_from_hash(F.col("content_hash"))).alias("doc_id"),
        F.coalesce("known.file_name", "first.file_name").alias("file_name"),
        F.coalesce("known.source_type", "first.source_type").alias("source_type"),
        F.coalesce("known.size_bytes", "first.size_bytes").alias("size_bytes"),
    )
    joined = lookup_join(light.select("seq", "content_hash"), decided, "content_hash", "copies", "seq", how="inner")
    return joined.select(
        "seq",
        "doc_id",
        "file_name",
        "source_type",
        "content_hash",
        "size_bytes",
        (~F.col("seq").eqNullSafe(F.col("new_seq"))).alias("deduped"),
    )


def fresh_documents(prepared: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The rows to index, with their texts, given the outcomes of `resolve_batch`."""
    return prepared.join(outcomes.where(~F.col("deduped")).select("seq", "doc_id"), "seq")


def new_documents(prepared: DataFrame, manifest: DataFrame) -> DataFrame:
    """The rows to index, with their texts: first of each hash and not in the manifest."""
    usable = prepared.where(F.col("error").isNull())
    firsts = usable.groupBy("content_hash").agg(F.min("seq").alias("seq"))
    fresh = firsts.join(manifest.select("content_hash").distinct(), "content_hash", "left_anti")
    return usable.join(fresh.select("seq"), "seq", "left_semi").withColumn(
        "doc_id", doc_id_from_hash(F.col("content_hash"))
    )


def manifest_rows(documents: DataFrame, date_added: Column) -> DataFrame:
    """Shape new documents as manifest rows; the time stamp is passed in so that a rerun gives the same rows."""
    return documents.select(
        "doc_id",
        "file_name",
        "source_type",
        "content_hash",
        F.col("chunk_count").cast("int").alias("chunk_count"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        date_added.cast("timestamp").alias("date_added"),
    )


def reconcile(status: DataFrame, manifest: DataFrame, date_added: Column, skip_doc_id: str | None = None) -> DataFrame:
    """Manifest rows for processed documents that have none."""
    done = status.where(F.col("status") == "processed")
    if skip_doc_id is not None:
        done = done.where(F.col("id") != skip_doc_id)
    missing = done.join(manifest.select(F.col("doc_id").alias("id")), "id", "left_anti")
    name = falsy(F.col("file_path"), F.col("id"))
    return missing.select(
        F.col("id").alias("doc_id"),
        name.alias("file_name"),
        F.coalesce(source_type_of(name), F.lit(UNKNOWN_TYPE)).alias("source_type"),
        F.concat(F.lit(RECONCILED_HASH_PREFIX), falsy(F.col("content_hash"), F.col("id"))).alias("content_hash"),
        F.coalesce("chunks_count", F.lit(0)).cast("int").alias("chunk_count"),
        F.coalesce("content_length", F.lit(0)).cast("long").alias("size_bytes"),
        date_added.cast("timestamp").alias("date_added"),
    )


def resolve_rejected(rejected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Inserts refused because their name is taken: the document of that name, or an error row with the way out."""
    by_name = pin_first(manifest, "file_name")
    counted = by_name.join(rejected.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n")), "file_name")
    joined = lookup_join(rejected.select("seq", "file_name"), counted, "file_name", "_n", "seq")
    hint = F.concat(
        F.lit("'"),
        F.col("file_name"),
        F.lit("'" + REJECTED_HINT),
    )
    return joined.select(
        "seq",
        "file_name",
        "doc_id",
        F.col("doc_id").isNotNull().alias("deduped"),
        F.when(F.col("doc_id").isNull(), hint).alias("error"),
    )


def failed_inserts(status: DataFrame) -> DataFrame:
    """Error rows of documents whose indexing failed."""
    return status.where(F.col("status") == "failed").select(
        F.col("id").alias("doc_id"), falsy(F.col("error_msg"), F.lit("Processing failed.")).alias("error")
    )


def split_outcomes(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of a batch; a bad row never fails the others."""
    return outcomes.where(F.col("error").isNull()).drop("error"), outcomes.where(F.col("error").isNotNull()).select(
        "file_name", "error"
    )


def listing(manifest: DataFrame) -> DataFrame:
    return manifest.select(*API_ROW).orderBy(F.desc("date_added"), F.asc("doc_id"))


def find(manifest: DataFrame, column: str, value: str) -> DataFrame:
    """Point lookup; the filter reaches the scan and the tie is broken by age, then id."""
    return manifest.where(F.col(column) == value).orderBy("date_added", "doc_id").limit(1)


def tombstones(status: DataFrame, deleted_names: DataFrame) -> DataFrame:
    """Failed `dup-` rows that block the names being deleted. `deleted_names`: (file_name)."""
    blocked = status.where((F.col("status") == "failed") & F.startswith("id", F.lit(TOMBSTONE_PREFIX)))
    return blocked.join(deleted_names.select(F.col("file_name").alias("file_path")).distinct(), "file_path", "left_semi")


def delete_documents(ids: DataFrame, manifest: DataFrame, status: DataFrame, **by_document: DataFrame) -> dict[str, DataFrame]:
    """Cascading delete. `ids`: (doc_id); further tables are given by name and must have a `doc_id` column.

    `outcome` tells for every requested id whether it was there; unknown ids delete nothing.
    """
    wanted = ids.select("doc_id").distinct()
    hit = manifest.join(wanted, "doc_id", "left_semi")
    stale = tombstones(status, hit.select("file_name")).select("id")
    gone = stale.unionByName(hit.select(F.col("doc_id").alias("id")))
    result = {
        "outcome": wanted.join(hit.select("doc_id", F.lit(True).alias("_hit")), "doc_id", "left").select(
            "doc_id", F.coalesce("_hit", F.lit(False)).alias("deleted")
        ),
        "manifest": manifest.join(wanted, "doc_id", "left_anti"),
        "status": status.join(gone, "id", "left_anti"),
    }
    found = hit.select("doc_id")
    for name, df in by_document.items():
        result[name] = df.join(found, "doc_id", "left_anti")
    return result


def status_by(status: DataFrame, state: str | None = None, track_id: str | None = None) -> DataFrame:
    if state is not None:
        status = status.where(F.col("status") == state)
    if track_id is not None:
        status = status.where(F.col("track_id") == track_id)
    return status


def resumable(status: DataFrame) -> DataFrame:
    """Documents an explicit resume would index again."""
    return status.where(F.col("status").isin(*RESUMABLE))


def create_manifest(spark: SparkSession, name: str) -> None:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MANIFEST)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet")


def append_manifest(rows: DataFrame, name: str) -> None:
    """Append rows whose id is new; the table format has no primary key, the anti join keeps it."""
    current = rows.sparkSession.table(name).select("doc_id")
    rows.select(*ROW).dropDuplicates(["doc_id"]).join(current, "doc_id", "left_anti").select(*ROW).write.insertInto(name)


def rewrite_manifest(rows: DataFrame, name: str) -> None:
    """Replace the table's rows. The new rows are made durable first because they are read from the same table."""
    checkpointed(rows.select(*ROW)).write.insertInto(name, overwrite=True)
