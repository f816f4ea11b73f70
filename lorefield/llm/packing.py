"""Packing of tokenised documents into fixed-length sequences: first-fit decreasing inside random groups of documents."""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITY = 1024
END_ID = 0
GROUP_ROWS = 1024
GROUP_BYTES = 8 << 20
# Bins with more padding than this share of their capacity are emptied and their content is cut anew.
LOOSE_SHARE = 1 / 64

PIECES = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class BinTree:
    """Tournament tree over the free space of bins; each inner node holds the larger free space of its two sides."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.leaves)

    def put(self, need: int) -> tuple[int, int]:
        """Place an item in the first bin with room for it; the bin and its free space before."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < need:
                node += 1
        before = free[node]
        free[node] = before - need
        where = node - self.leaves
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
        return where, before


def plan(sizes: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these sizes, all at least 1.

    A document's full stretches of `capacity` are sequences of their own; what remains of each document is placed by
    first-fit decreasing. Content of bins that stay too empty is laid end to end and cut at the capacity.
    """
    pieces, rests, count = [], [], 0
    for doc, size in enumerate(sizes):
        for start in range(0, size - size % capacity, capacity):
            pieces.append((doc, start, capacity, count, 0))
            count += 1
        if size % capacity:
            rests.append((size % capacity, doc))
    rests.sort(key=lambda rest: (-rest[0], rest[1]))
    tree = BinTree(len(rests), capacity)
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for length, doc in rests:
        where, before = tree.put(length)
        bins.setdefault(where, []).append((doc, length, capacity - before))
    loose = []
    for where in sorted(bins):
        used = capacity - tree.free[tree.leaves + where]
        if capacity - used > capacity * LOOSE_SHARE and used & (used - 1):
            loose += bins[where]
            continue
        pieces += [(doc, sizes[doc] - length, length, count, offset) for doc, length, offset in bins[where]]
        count += 1
    offset = 0
    for doc, length, _ in loose:
        start = sizes[doc] - length
        while length:
            part = min(length, capacity - offset)
            pieces.append((doc, start, part, count, offset))
            start, length, offset = start + part, length - part, offset + part
            if offset == capacity:
                count, offset = count + 1, 0
    return pieces


@lru_cache(maxsize=2)
def encoder(ranks: str, pattern: str, special: str, special_id: int):
    """Fast encoder for a byte-level vocabulary; `special` is the one string that the vocabulary treats as a token of its own."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=table, special_tokens={special: special_id})


def pack(
    docs: DataFrame,
    ranks: str,
    pattern: str,
    special: tuple[str, int] = ("<|endoftext|>", 50256),
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    group_rows: int = GROUP_ROWS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """One row per piece: the key, start, length, ids_crc32, doc_tokens, sequence_id and offset.

    A document's tokens are its text's ids and one END_ID; a null or empty text is END_ID alone. Every row is a
    document, repeated ones too. Documents fall into groups by a hash of id and text; the number of groups follows the
    rows and bytes of the table, so a group's content is bounded. No rows give no pieces.
    """
    name, number = special
    size = F.coalesce(F.octet_length(text), F.lit(0))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    groups = max(1, -(-total["n"] // group_rows), -(-(total["b"] or 0) // group_bytes))

    def place(table: pa.Table) -> pa.Table:
        encode = encoder(ranks, pattern, name, number)
        texts = table.column("_text").to_pylist()
        coded = [np.append(encode.encode_to_numpy(t, allowed_special="all"), END_ID).astype("<u4") if t else np.array([END_ID], "<u4") for t in texts]
        marks = [(k is None, k, zlib.crc32(c.tobytes())) for k, c in zip(table.column("_key").to_pylist(), coded, strict=True)]
        order = sorted(range(len(coded)), key=lambda i: (marks[i][0], marks[i][1] or 0, marks[i][2]))
        pieces = plan([len(coded[i]) for i in order], capacity)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in (zip(*pieces) if pieces else [()] * 5))
        row = np.array(order, np.int64)[doc]
        crc = [zlib.crc32(coded[r][s : s + n].tobytes()) for r, s, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
        sizes = np.array([len(c) for c in coded], np.int64)
        group = table.column("_group")[0].as_py()
        columns = [start, length, np.array(crc, np.int64), sizes[row], (group << 32) + sequence, offset]
        return pa.table([table.column("_key").take(pa.array(row)), *map(pa.array, columns)], ["_key", *PIECES.names])

    chosen = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    grouped = chosen.withColumn("_group", F.pmod(F.xxhash64("_key", F.lit("group"), "_text"), F.lit(groups)))
    return grouped.groupBy("_group").applyInArrow(place, T.StructType([T.StructField("_key", T.LongType()), *PIECES.fields])).withColumnRenamed("_key", key)
