"""Client-side upload list and history folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.operators.skew import lookup_join, running
from lorefield.session import checkpointed

# --- fixed values ---
FINISHED = ("done", "error")
# --------------------

# Turns held together when a conversation is collected.
PAGE_TURNS = 256


def newest_first(uploads: DataFrame) -> DataFrame:
    return uploads.orderBy(F.desc("seq"))


def unfinished(uploads: DataFrame) -> DataFrame:
    return uploads.where(~F.col("status").isin(*FINISHED))


def patch(uploads: DataFrame, patches: DataFrame) -> DataFrame:
    """Overlay (id, status, error) patches; a null patch field keeps the old value."""
    p = patches.select("id", F.col("status").alias("_s"), F.col("error").alias("_e"))
    return uploads.join(p, "id", "left").withColumns(
        {"status": F.coalesce("_s", "status"), "error": F.coalesce("_e", "error")}
    ).drop("_s", "_e")


def results_to_uploads(results: DataFrame, uploads: DataFrame) -> DataFrame:
    """Attach each result (with an `id`) to the first upload of the same name; repeated names all hit that first row."""
    first = uploads.groupBy("file_name").agg(F.min("idx").alias("idx"))
    weighed = first.join(results.groupBy("file_name").agg(F.count(F.lit(1)).alias("_n")), "file_name")
    return lookup_join(results, weighed, "file_name", "_n", "id").drop("_n")


def last_by_role(messages: DataFrame) -> DataFrame:
    """Last message of every role in a conversation: (conv_id, turn, role, text)."""
    return messages.groupBy("conv_id", "role").agg(
        F.max("turn").alias("last_turn"), F.max_by("text", "turn").alias("last_text")
    )


def message_json(role: Column, text: Column) -> Column:
    return F.to_json(F.struct(role.alias("role"), text.alias("content")))


def history_before(messages: DataFrame) -> DataFrame:
    """For every user turn, how many earlier messages are passed on with it, and the turn they end at.

    The history itself is the rows of the same conversation with a smaller turn. Counting runs over pages of turns,
    so a very long conversation is neither copied into its later rows nor held by one task.
    """
    paged = messages.select("conv_id", "turn", "role").withColumn("_page", F.floor(F.col("turn") / PAGE_TURNS))
    counted = checkpointed(running(paged, ["conv_id"], "_page", ["turn"], F.lit(1), "history_len", "sum", exclusive=True))
    ended = running(counted, ["conv_id"], "_page", ["turn"], F.col("turn"), "history_last_turn", "max", exclusive=True)
    return ended.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("history_len").cast("long").alias("history_len"), "history_last_turn"
    )


def conversation_state(messages: DataFrame, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Ordered messages per session in pages of bounded length: (conv_id, page, history)."""
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    page = F.floor(F.col("turn") / page_turns).alias("page")
    return messages.groupBy("conv_id", page).agg(
        F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history")
    )
