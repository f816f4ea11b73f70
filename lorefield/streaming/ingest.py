"""Incremental ingest: a stream of documents, deduplicated by content hash against everything stored before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.functions.text import content_hash, py_strip
from lorefield.plans.ingest import IndexOptions
from lorefield.plans.store import Store, add_batch

PART = "hash_part"
PART_DIGITS = 2


def hashed_stream(documents: DataFrame) -> DataFrame:
    """Documents with text, their content hash and the part of the table that holds it. When a document arrived plays no role."""
    stripped = documents.withColumn("text", py_strip(F.col("text"))).where(F.col("text") != "")
    hashed = stripped.withColumn("content_hash", content_hash(F.col("text")))
    return hashed.withColumn(PART, F.substring("content_hash", 1, PART_DIGITS))


def append_new(target: str):
    """foreachBatch writer: add rows whose hash the target does not hold. A replayed batch adds nothing twice.

    Only the parts of the table that the batch's hashes can be in are read; their names are at most 16 ** PART_DIGITS.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.dropDuplicates(["content_hash"])
        parts = [r[0] for r in batch.select(PART).distinct().collect()]
        stored = batch.sparkSession.read.schema(batch.schema).parquet(target).where(F.col(PART).isin(parts))
        fresh = rows.join(stored.select(PART, "content_hash"), [PART, "content_hash"], "left_anti").select(*batch.columns)
        fresh.write.mode("append").partitionBy(PART).parquet(target)

    return write


def run_to_end(stream: DataFrame, target: str, checkpoint: str, **options: str) -> DataFrame:
    """Drain what the source holds now into `target` and return it as a table."""
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).write.mode("append").partitionBy(PART).parquet(target)
    query = (
        stream.writeStream.foreachBatch(append_new(target))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .options(**options)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def drain(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Run an append stream over what the source holds now; the file sink commits each batch once."""
    query = (
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def index_batches(store: Store, date_added: Column, options: IndexOptions = IndexOptions()):
    """foreachBatch writer: every micro-batch (seq, file_name, source_type, text) goes whole into the stored base or not at all.

    Contents that are stored already, by whatever batch, are only looked up, so a replayed batch changes nothing.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        own = Store(batch.sparkSession, store.base, store.parts)
        add_batch(own, batch, date_added, options, track_id=f"batch-{batch_id}")

    return write


def index_to_end(stream: DataFrame, store: Store, checkpoint: str, date_added: Column, options: IndexOptions = IndexOptions()) -> None:
    """Index what the source holds now; the source's `maxFilesPerTrigger` bounds a batch."""
    query = stream.writeStream.foreachBatch(index_batches(store, date_added, options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
