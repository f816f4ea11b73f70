"""Chat answers as ordered events and their wire frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.functions.arrays import explode_rows

# --- fixed values ---
FRAME_PREFIX = "data: "
FRAME_END = "\n\n"
# --------------------


def frame(payload: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit(FRAME_PREFIX), payload, F.lit(FRAME_END))


def source_list(references: Column) -> Column:
    """Known fields of the references only; a missing list counts as empty."""
    empty = F.expr("cast(array() as array<struct<reference_id:string,file_path:string>>)")
    picked = F.transform(
        references, lambda r: F.struct(r["reference_id"].alias("reference_id"), r["file_path"].alias("file_path"))
    )
    return F.coalesce(picked, empty)


def answer_events(answers: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, seq, type, payload) of every answer: sources, the non-empty tokens, done; or one error alone.

    `answers`: keys, references array<struct<reference_id, file_path>>, chunks array<string>, failure string.
    An answer that fails while it streams (`failed_at` given) ends with the error in place of the rest.
    """
    failed_at = F.col("failed_at") if "failed_at" in answers.columns else F.lit(None).cast("int")
    sources = F.to_json(F.struct(F.lit("sources").alias("type"), source_list(F.col("references")).alias("sources")))
    sent = F.when(failed_at.isNull(), F.col("chunks")).otherwise(F.slice(F.col("chunks"), 1, F.coalesce(failed_at, F.lit(0))))
    tokens = F.transform(
        F.filter(F.coalesce(sent, F.expr("cast(array() as array<string>)")), lambda c: F.length(c) > 0),
        lambda c: F.struct(F.lit("token").alias("type"), F.to_json(F.struct(F.lit("token").alias("type"), c.alias("text"))).alias("payload")),
    )
    error = F.struct(
        F.lit("error").alias("type"),
        F.to_json(F.struct(F.lit("error").alias("type"), F.col("failure").alias("message"))).alias("payload"),
    )
    done = F.struct(F.lit("done").alias("type"), F.to_json(F.struct(F.lit("done").alias("type"))).alias("payload"))
    first = F.struct(F.lit("sources").alias("type"), sources.alias("payload"))
    broken = F.col("failure").isNotNull()
    events = (
        F.when(broken & failed_at.isNull(), F.array(error))
        .when(broken, F.concat(F.array(first), tokens, F.array(error)))
        .otherwise(F.concat(F.array(first), tokens, F.array(done)))
    )
    rows = explode_rows(answers, events, *keys, pos="seq", item="e")
    return rows.select(*keys, "seq", F.col("e.type").alias("type"), F.col("e.payload").alias("payload"))


def frames(events: DataFrame) -> DataFrame:
    return events.withColumn("frame", frame(F.col("payload")))


def parse_frames(buffer: Column) -> Column:
    """Complete `data:` payloads of a received buffer; the unfinished tail and other lines are left out."""
    pieces = F.split(buffer, FRAME_END)
    complete = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    lines = F.filter(F.transform(complete, F.trim), lambda x: F.startswith(x, F.lit("data:")))
    return F.transform(lines, lambda x: F.trim(F.substring(x, 6, 2147483647)))


def unread_tail(buffer: Column) -> Column:
    return F.element_at(F.split(buffer, FRAME_END), -1)


def fold_tokens(payloads: Column) -> Column:
    """Message text from the payloads in order."""
    texts = F.transform(
        F.filter(payloads, lambda p: F.get_json_object(p, "$.type") == "token"), lambda p: F.get_json_object(p, "$.text")
    )
    return F.array_join(texts, "")
