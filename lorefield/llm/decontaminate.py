"""Documents that hold passages of test items.

Each shard of documents becomes an FM-index over word numbers; every window of the test items is searched backward,
its occurrences are located, and overlapping ones merge into spans of words. Words that no test item holds cannot be
part of an occurrence: in the index they only end a passage, and passages shorter than the shortest window are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm import flat
from lorefield.llm.arrow import extended, ragged, with_columns
from lorefield.llm.fmindex import FMIndex
from lorefield.session import checkpointed

WINDOW = 10
SHARD_BYTES = 32 << 20
ITEM_BLOCK_BYTES = 32 << 20
SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


@dataclass(frozen=True)
class Phrases:
    """Distinct windows as word numbers, and the items of each (a ragged list)."""

    words: np.ndarray
    known: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = flat.text_bytes(texts)
    data = flat.lower_ascii(data)
    start, end, doc = flat.word_bounds(flat.WORD_BYTES[data], bounds)
    return flat.word_hashes(data, start, end), np.bincount(doc, minlength=len(bounds) - 1)


def phrases(item_ids: list[int], texts: list[str], window: int = WINDOW) -> Phrases:
    hashes, counts = _word_hashes(pa.array(texts, pa.string()))
    words, number = np.unique(hashes, return_inverse=True)
    found: dict[tuple[int, ...], set[int]] = {}
    at = 0
    for item, n in zip(item_ids, counts.tolist(), strict=True):
        mine = (number[at : at + n] + 1).tolist()
        at += n
        for i in range(max(1, n - window + 1) if n else 0):
            found.setdefault(tuple(mine[i : i + window]), set()).add(item)
    rows = np.zeros((len(found), window), np.int64)
    for i, phrase in enumerate(found):
        rows[i, : len(phrase)] = phrase
    known = np.zeros(1 << 20, bool)
    known[words & np.uint64((1 << 20) - 1)] = True
    sizes = np.array([len(x) for x in found.values()], np.int64)
    items = np.array([i for x in found.values() for i in sorted(x)], np.int64)
    return Phrases(words, known, rows, (rows > 0).sum(1), np.concatenate(([0], np.cumsum(sizes))), items)


def _numbers(hashes: np.ndarray, query: Phrases) -> np.ndarray:
    """Word numbers of the test items' words; 0 for every other word."""
    out = np.zeros(len(hashes), np.int64)
    maybe = np.flatnonzero(query.known[hashes & np.uint64((1 << 20) - 1)])
    at = np.minimum(np.searchsorted(query.words, hashes[maybe]), max(0, len(query.words) - 1))
    out[maybe] = np.where(query.words[at] == hashes[maybe], at + 1, 0) if len(query.words) else 0
    return out


class _Shard:
    """Documents gathered for one index: their batches, word counts and the passages worth indexing."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.symbols: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.words = self.size = 0

    def add(self, part: pa.RecordBatch, texts: pa.Array, query: Phrases) -> None:
        hashes, counts = _word_hashes(texts)
        number = _numbers(hashes, query)
        doc = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(number)
        if len(at) and len(query.lengths):
            new = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(doc[at]) != 0)))
            run = np.cumsum(new) - 1
            sizes = np.bincount(run)
            kept = (sizes >= query.lengths.min())[run]
            at, run = at[kept], run[kept]
            ends = np.flatnonzero(np.diff(run)) + 1
            symbols = np.insert(number[at], ends, 0)
            self.symbols.append(np.append(symbols, 0)[: len(symbols) + (len(symbols) > 0)])
            self.places.append(np.append(np.insert(at, ends, -1), -1)[: len(self.symbols[-1])] + self.words)
        self.parts.append(part)
        self.counts.append(counts)
        self.words += len(hashes)
        self.size += flat.text_bytes(texts)[0].nbytes

    def occurrences(self, query: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """First word of every occurrence of a window, and the window's number."""
        symbols = np.concatenate(self.symbols) if self.symbols else np.empty(0, np.int64)
        if not len(symbols):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        index = FMIndex(symbols)
        low, high = index.search(query.rows, query.lengths)
        hits = high - low
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        return np.concatenate(self.places)[index.locate(rows)], which


def _merged(first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of word ranges that overlap or touch inside a document."""
    if not len(first):
        return first, last, doc
    order = np.lexsort((first, doc))
    first, last, doc = first[order], np.maximum.accumulate(last[order]), doc[order]
    new = np.concatenate(([True], (first[1:] > last[:-1]) | (doc[1:] != doc[:-1])))
    at = np.flatnonzero(new)
    return first[at], last[np.concatenate((at[1:], [len(first)])) - 1], doc[at]


def _search(query: Phrases, text: str, earlier: bool, shard_bytes: int):
    def finish(shard: _Shard) -> Iterator[pa.RecordBatch]:
        counts = np.concatenate(shard.counts)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        first, which = shard.occurrences(query)
        doc = np.searchsorted(bounds, first, "right") - 1
        last = first + query.lengths[which]
        held = query.first[which + 1] - query.first[which]
        item = query.items[np.repeat(query.first[which], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)]
        pairs = np.unique(np.stack((np.repeat(doc, held), item)), axis=1) if len(item) else np.zeros((2, 0), np.int64)
        if earlier:
            old_doc, old_first, old_last, old_items = [], [], [], []
            at = 0
            for part in shard.parts:
                for row in part.select(["spans", "items"]).to_pylist():
                    for span in row["spans"]:
                        old_doc.append(at), old_first.append(span["first"] + bounds[at]), old_last.append(span["last"] + bounds[at])
                    old_items += [(at, i) for i in row["items"]]
                    at += 1
            first, last, doc = (np.concatenate((a, np.array(b, np.int64))) for a, b in ((first, old_first), (last, old_last), (doc, old_doc)))
            pairs = np.unique(np.concatenate((pairs, np.array(old_items, np.int64).reshape(-1, 2).T), axis=1), axis=1)
        first, last, doc = _merged(first, last, doc)
        at = 0
        for part in shard.parts:
            to = at + part.num_rows
            a, b = np.searchsorted(doc, (at, to))
            c, d = np.searchsorted(pairs[0], (at, to))
            ranges = pa.StructArray.from_arrays([pa.array(first[a:b] - bounds[doc[a:b]]), pa.array(last[a:b] - bounds[doc[a:b]])], ["first", "last"])
            found = {
                "n_words": pa.array(counts[at:to].astype(np.int64)),
                "spans": ragged(ranges, np.bincount(doc[a:b] - at, minlength=to - at)),
                "items": ragged(pa.array(pairs[1, c:d]), np.bincount(pairs[0, c:d] - at, minlength=to - at)),
            }
            yield with_columns(part, found)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for part in flat.slices(batches, text):
            shard.add(part, part.column(part.schema.get_field_index(text)), query)
            if shard.size >= shard_bytes:
                yield from finish(shard)
                shard = _Shard()
        if shard.parts:
            yield from finish(shard)

    return run


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = ITEM_BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`docs` with n_words, spans (first and last word, end exclusive, of merged occurrences) and items (ids found).

    `items` has item_id and text. Words are runs of digits, letters a-z and non-ASCII characters after lower-casing A-Z;
    an item of fewer words than `window` is one window. Null texts and texts without words have no windows; an item
    without an id is no item; rows that repeat an item add nothing. Test items are searched in blocks of about
    `block_bytes`, one after the other, and each block's size is measured before it goes to the tasks. With no items
    nothing is found. Columns of the three names are replaced.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    wanted = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = wanted.agg(F.sum(size).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.LongType()))]
    rows = docs
    for block in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        query = phrases([r["item_id"] for r in mine], [r["text"] for r in mine], window)
        rows = rows.mapInArrow(_search(query, text, block > 0, shard_bytes), extended(rows, fields))
        if block + 1 < blocks:
            rows = checkpointed(rows)
    return rows


def hit_words(spans: Column) -> Column:
    """Words inside the merged spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
