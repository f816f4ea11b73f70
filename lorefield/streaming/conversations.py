"""Conversation state kept by a stream: the messages of each session in order, however often or late they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lorefield.operators.uploads import PAGE_TURNS

MESSAGE = "turn long, role string, content string"
STATE = f"conv_id string, page long, messages array<struct<{MESSAGE.replace(' ', ':').replace(',:', ',')}>>, closed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
IDLE_SECONDS = 3600.0


class Pages(StatefulProcessor):
    """List state of one page of a session, a bounded number of turns. A turn that arrives again replaces itself, and a late
    one takes its place; a page whose last message is `idle` seconds behind the watermark is given out a last time and forgotten."""

    def __init__(self, idle: float):
        self.idle_ms = int(idle * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.messages = handle.getListState("messages", MESSAGE)

    def _row(self, key, held: list[tuple], closed: bool) -> pd.DataFrame:
        messages = [{"turn": t, "role": r, "content": c} for t, r, c in held]
        return pd.DataFrame({"conv_id": [key[0]], "page": [key[1]], "messages": [messages], "closed": [closed]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {m[0]: tuple(m) for m in self.messages.get()}
        last = 0
        for part in rows:
            last = max(last, int(part["at_ms"].max()))
            for turn, role, text in zip(part["turn"], part["role"], part["text"], strict=True):
                held[int(turn)] = (int(turn), None if pd.isna(role) else role, None if pd.isna(text) else text)
        ordered = [held[t] for t in sorted(held)]
        self.messages.put(ordered)
        timers = list(self.handle.listTimers())
        expiry = max([last + self.idle_ms, *timers])
        for timer in timers:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(expiry, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, ordered, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [tuple(m) for m in self.messages.get()]
        self.messages.clear()
        yield self._row(key, held, True)

    def close(self) -> None:
        pass


def conversation_pages(messages: DataFrame, idle: float = IDLE_SECONDS, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Stream of (conv_id, page, messages, closed) from one of (conv_id, turn, role, text): a page whenever it changes.

    The event time is that of arrival, so a late message, whose turn is older than others, is never behind the watermark: it
    takes its place in the order of turns. Messages without a session or a turn belong to no page and are left out. The
    session's state store must be one that keeps lists: `run_to_end` sets it.
    """
    arrived = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("arrived", F.current_timestamp()).withWatermark("arrived", "0 seconds")
    rows = arrived.select(F.col("conv_id").cast("string"), F.col("turn").cast("long"), "role", "text", "arrived", F.unix_millis("arrived").alias("at_ms"))
    paged = rows.withColumn("page", F.floor(F.col("turn") / page_turns).cast("long"))
    return paged.groupBy("conv_id", "page").transformWithStateInPandas(Pages(idle), outputStructType=STATE, outputMode="Update", timeMode="EventTime")


def _keep(target: str):
    """foreachBatch writer: a folder for each batch, which a batch that runs again writes over."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def run_to_end(messages: DataFrame, target: str, checkpoint: str, idle: float = IDLE_SECONDS, page_turns: int = PAGE_TURNS) -> DataFrame:
    """Drain what the source holds now into `target`; gives the histories."""
    spark = messages.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        pages = conversation_pages(messages, idle, page_turns)
        query = pages.writeStream.foreachBatch(_keep(target)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    query.awaitTermination()
    return histories(spark, target)


def histories(spark: SparkSession, target: str) -> DataFrame:
    """(conv_id, page, history) like `uploads.conversation_state`. Of a turn the version of the latest batch counts, so pages
    that were forgotten and began again are whole."""
    stored = spark.read.schema(f"{STATE}, batch long").parquet(target)
    turns = stored.select("conv_id", "page", "batch", F.explode("messages").alias("m"))
    latest = turns.groupBy("conv_id", "page", F.col("m.turn").alias("turn")).agg(F.max_by("m", "batch").alias("m"))
    # A page holds a bounded number of turns.
    ordered = F.array_sort(F.collect_list("m"))
    return latest.groupBy("conv_id", "page").agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("history"))
