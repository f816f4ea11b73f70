"""Real token counts and windows: a byte-pair vocabulary in Arrow tasks, with the characters that every token covers.

A vocabulary is a file of ranks (base64 token, rank) and the pattern that splits texts before merging; both are parameters, and
every Python worker loads them once, so the file must be readable on all nodes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.operators.chunks import CHUNK_OVERLAP_TOKENS, CHUNK_TOKENS


@dataclass(frozen=True)
class Vocabulary:
    path: str
    pattern: str


@lru_cache(maxsize=2)
def _loaded(vocabulary: Vocabulary):
    """The encoder, and by token the characters that begin in it and whether it begins inside one."""
    import tiktoken

    with open(vocabulary.path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    begins, inside = np.zeros(max(ranks.values()) + 1, np.int64), np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        begins[rank] = sum(byte & 0xC0 != 0x80 for byte in token)
        inside[rank] = token[0] & 0xC0 == 0x80
    return tiktoken.Encoding("ranks", pat_str=vocabulary.pattern, mergeable_ranks=ranks, special_tokens={}), begins, inside


def encoded(text: str | None, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids, and the place of the first character of each token; one more place is the end. A token that begins inside a
    character begins, as a place, where that character does."""
    encoder, begins, inside = _loaded(vocabulary)
    ids = np.array(encoder.encode_ordinary(text or ""), np.int64)
    ends = np.cumsum(begins[ids])
    return ids, np.concatenate((np.concatenate(([0], ends))[:-1] - inside[ids], [len(text or "")])) if len(ids) else np.zeros(1, np.int64)


def with_token_count(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "tokens") -> DataFrame:
    """Rows with the number of tokens of their text; null and empty texts have none. A column of that name is replaced."""
    kept = [f for f in df.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(vocabulary)[0]
        for rows in batches:
            texts = rows.column(rows.schema.get_field_index(text))
            counts = pa.array([len(encoder.encode_ordinary(t.as_py() or "")) for t in texts], pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(f.name)) for f in kept), counts], [*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.IntegerType())]))


def windows(count: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """(first token, number of tokens): a window at every step of `size - overlap` tokens, the last ones shorter."""
    return [(at, min(size, count - at)) for at in range(0, count, size - overlap)]


def chunk_by_vocabulary(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP_TOKENS) -> DataFrame:
    """One row per window of tokens: (doc_id, chunk_index, chunk_id, content, token_count, token_start, first, last).

    `content` is the text from character `first` to `last`, exclusive; where a window starts inside a character, it starts at that
    character. Windows are made one after another as their text is read, so a long text costs its tokens and no copies of it.
    Texts that are null or empty have no window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType)]
    fields += [T.StructField(n, T.IntegerType()) for n in ("chunk_index", "token_start", "token_count", "first", "last")]
    fields.append(T.StructField("content", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, value in zip(rows.column(0), rows.column(1), strict=True):
                whole = value.as_py()
                ids, places = encoded(whole, vocabulary)
                cut = windows(len(ids), size, overlap)
                if not cut:
                    continue
                start, count = (np.array(x, np.int32) for x in zip(*cut, strict=True))
                first, last = places[start].astype(np.int32), places[start + count].astype(np.int32)
                content = pa.array([whole[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], pa.string())
                keys = pa.array([key.as_py()] * len(cut), rows.schema.field(0).type)
                columns = [keys, pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(start), pa.array(count), pa.array(first), pa.array(last), content]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    made = docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, T.StructType(fields))
    chunk_id = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")), 256)
    return made.select("doc_id", "chunk_index", chunk_id.alias("chunk_id"), "content", "token_count", "token_start", "first", "last")
