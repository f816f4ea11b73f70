"""Chunking: token windows, the separator cascade and chunk rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.functions.arrays import explode_rows, let
from lorefield.functions.text import NON_WS, WS, content_hash, count_tokens, py_strip

# --- fixed values ---
CHUNK_TOKENS = 1024
CHUNK_OVERLAP_TOKENS = 100
CASCADE_TOKENS = 512
CASCADE_OVERLAP_TOKENS = 64
CASCADE_SEPARATORS = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", "")
# --------------------


def token_pieces(text: Column) -> Column:
    """White-space tokens with the space after them, so that a slice keeps its line breaks."""
    return F.regexp_extract_all(text, F.lit(f"{NON_WS}+{WS}*"), F.lit(0))


def token_windows(pieces: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP_TOKENS) -> Column:
    """array<struct<token_start, token_count, content>> of overlapping windows over the tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")

    def build(tokens: Column) -> Column:
        count = F.size(tokens)
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(size - overlap))).otherwise(
            F.expr("cast(array() as array<int>)")
        )
        return F.transform(
            starts,
            lambda at: F.struct(
                at.alias("token_start"),
                F.least(F.lit(size), count - at).alias("token_count"),
                py_strip(F.array_join(F.slice(tokens, at + 1, F.lit(size)), "")).alias("content"),
            ),
        )

    return let(pieces, build)


def chunk_by_tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP_TOKENS
) -> DataFrame:
    """One row per chunk: (doc_id, chunk_index, chunk_id, content, token_count). Narrow: no shuffle."""
    parts = token_windows(token_pieces(py_strip(F.col(text))), size, overlap)
    exploded = explode_rows(docs, parts, doc_id, pos="chunk_index", item="w").withColumnRenamed(doc_id, "doc_id")
    return exploded.select(
        "doc_id",
        "chunk_index",
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256).alias("chunk_id"),
        F.col("w.content").alias("content"),
        F.col("w.token_count").alias("token_count"),
    )


def with_chunk_facts(chunks: DataFrame) -> DataFrame:
    return chunks.withColumns(
        {"char_count": F.length("content"), "content_hash": F.sha2("content", 256)}
    )


def _quarter(start: int, end: int) -> int:
    """Tokens of a span when no tokenizer is at hand."""
    return (end - start) // 4


def _last_within(measure: Callable[[int, int], int], start: int, end: int, limit: int) -> int:
    """Largest place up to `end` at which the span from `start` still fits the limit, at least one character on."""
    low, step = start + 1, 1
    while low + step <= end and measure(start, low + step) <= limit:
        low, step = low + step, step * 2
    high = min(end, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if measure(start, middle) <= limit else (low, middle - 1)
    return low


def cascade_spans(
    text: str,
    size: int = CASCADE_TOKENS,
    overlap: int = CASCADE_OVERLAP_TOKENS,
    separators: Sequence[str] = CASCADE_SEPARATORS,
    measure: Callable[[int, int], int] = _quarter,
) -> list[tuple[int, int]]:
    """Chunks of a text as spans, none over `size` tokens.

    The text is one region. A region is divided at its coarsest separator, and its pieces are joined while the span from
    the first to the last of them fits; the next chunk begins as many whole pieces earlier as `overlap` allows. A piece
    that does not fit is a region of its own, divided at finer separators, and cut by width where it has none. Chunks
    come in text order. `measure` gives the tokens of a span and must not fall when the span grows; with the default
    every separator passes over the text once.
    """
    finer = [s for s in separators if s]
    out: list[tuple[int, int]] = []
    regions = [(0, len(text), 0)]
    while regions:
        start, end, level = regions.pop()
        if start == end or measure(start, end) <= size:
            out += [(start, end)] if start < end else []
            continue
        while level < len(finer) and text.find(finer[level], start, end) < 0:
            level += 1
        if level == len(finer):
            while True:
                stop = _last_within(measure, start, end, size)
                out.append((start, stop))
                if stop == end:
                    break
                back = stop - 1
                while back > start + 1 and measure(back - 1, stop) <= overlap:
                    back -= 1
                start = back if overlap and measure(back, stop) <= overlap else stop
            continue
        later = _join_pieces(text, start, end, finer[level], size, overlap, measure, out)
        if later is not None:
            piece_start, piece_end = later
            regions.append((min(end, piece_end + len(finer[level])), end, level))
            regions.append((piece_start, piece_end, level + 1))
    return out


def _join_pieces(text, start, end, separator, size, overlap, measure, out) -> tuple[int, int] | None:
    """Append the chunks of a region up to its first piece that does not fit, and return that piece."""
    held: deque[tuple[int, int]] = deque()
    at = start
    while at <= end:
        stop = text.find(separator, at, end)
        stop = end if stop < 0 else stop
        if measure(at, stop) > size:
            if held and held[-1][1] > held[0][0]:
                out.append((held[0][0], held[-1][1]))
            return at, stop
        if held and measure(held[0][0], stop) > size:
            last = held[-1][1]
            if last > held[0][0]:
                out.append((held[0][0], last))
            while held and (measure(held[0][0], last) > overlap or measure(held[0][0], stop) > size):
                held.popleft()
        held.append((at, stop))
        at = stop + len(separator)
    if held and held[-1][1] > held[0][0]:
        out.append((held[0][0], held[-1][1]))
    return None


def cascade_split(
    text: str,
    size: int = CASCADE_TOKENS,
    overlap: int = CASCADE_OVERLAP_TOKENS,
    separators: Sequence[str] = CASCADE_SEPARATORS,
    cost: Callable[[str], int] | None = None,
) -> list[str]:
    """Texts of the spans; `cost` counts the tokens of a string."""
    measure = _quarter if cost is None else lambda start, end: cost(text[start:end])
    return [text[start:end] for start, end in cascade_spans(text, size, overlap, separators, measure)]


def cascade_chunks_udf(
    size: int = CASCADE_TOKENS,
    overlap: int = CASCADE_OVERLAP_TOKENS,
    separators: Sequence[str] = CASCADE_SEPARATORS,
    cost: Callable[[str], int] | None = None,
):
    """Arrow function string -> array<string>. The recursion depends on the data, so it cannot be a plan."""
    separators = tuple(separators)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunks(texts: pd.Series) -> pd.Series:
        return pd.Series([cascade_split(t, size, overlap, separators, cost) if t else [] for t in texts])

    return chunks


def chunk_by_cascade(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    split = cascade_chunks_udf(**options)
    split_docs = docs.select(F.col(doc_id).alias("doc_id"), split(F.col(text)).alias("parts"))
    rows = explode_rows(split_docs, F.col("parts"), "doc_id", pos="chunk_index", item="content")
    return with_chunk_facts(rows.withColumn("token_count", count_tokens(F.col("content"))))


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks per document, 0 where there are none."""
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return docs.join(counted, "doc_id", "left").withColumn("chunk_count", F.coalesce("n", F.lit(0))).drop("n")


def document_hash(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", content_hash(F.col(text)))
