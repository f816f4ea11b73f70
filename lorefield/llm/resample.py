"""Importance resampling of documents towards a target collection, without replacement.

A document's weight is the sum of the log ratios of its hashed word runs in the target and in the documents; with Gumbel
noise from its id, the documents of the highest scores are a weighted draw. The lowest drawn key is found exactly by a
weighted median of medians: every batch of keys gives its median, every task the weighted median of those, and the driver
the weighted median of the tasks'. At least an eighth of the remaining keys lies on either side of it, so each round
throws a guaranteed share away, until one key is left. Only the drawn documents are sorted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm.arrow import with_columns
from lorefield.session import checkpointed

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Digits, letters without case, and every byte of a longer character.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RUN_WORDS = 1 << 16
#: The remaining keys are stored anew when they are fewer than this share of those stored.
STORE_SHARE = 1 / 64

KEY_ORDER = [("score", "descending"), ("key", "ascending"), ("row", "ascending")]


def feature_buckets(text: bytes, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Runs of words: how many there are, and the buckets of the features (1 to 3 words) that end in them."""
    found = WORD.finditer(text.lower())
    before: list[bytes] = []
    while fresh := [m.group() for m in islice(found, RUN_WORDS)]:
        words, skip = before + fresh, len(before)
        spaced = [b" " + w for w in words]
        one = [crc32(w) for w in words]
        two = [crc32(w, c) for c, w in zip(one, spaced[1:], strict=False)]
        three = [crc32(w, c) for c, w in zip(two, spaced[2:], strict=False)]
        yield len(fresh), np.array(one[skip:] + two[max(0, skip - 1) :] + three[max(0, skip - 2) :], np.int64) % buckets
        before = words[-2:]


def _counting(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py() or b"", buckets):
                    total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: every task sums its own, and as many numbers as there are buckets come back."""
    counted = texts.select(F.col(text).cast("binary").alias("text")).mapInArrow(_counting(buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's smoothed share in the target and in the documents."""
    n, s, t = len(documents), float(documents.sum()), float(target.sum())
    ratio = [(float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)) for a, b in zip(documents.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def _weighing(gain: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((batch.num_rows, 3), np.int64)
            for row, text in zip(sums, batch.column(1), strict=True):
                for words, found in feature_buckets(text.as_py() or b"", len(gain)):
                    row += (words, len(found), gain[found].sum())
            yield with_columns(batch.select(["key"]), {name: pa.array(sums[:, i].copy()) for i, name in enumerate(("n_words", "n_features", "weight"))})

    return run


def noise(key: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the key's hash; a null key counts as an empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def scored(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, row) of every document, stored; row tells repeated rows apart."""
    kind = docs.schema[key].dataType
    fields = [T.StructField("key", kind), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).mapInArrow(_weighing(gain), T.StructType(fields))
    return checkpointed(rows.withColumns({"score": F.col("weight") + noise(F.col("key"), seed), "row": F.monotonically_increasing_id()}))


def up_to(pivot: Row) -> Column:
    """Whether a key stands before the pivot or is it: higher scores first, then smaller keys, nulls last, then earlier rows."""
    score, key = F.col("score"), F.col("key")
    before = key.isNotNull() if pivot.key is None else key < F.lit(pivot.key)
    same = key.eqNullSafe(F.lit(pivot.key)) & (F.col("row") <= pivot.row)
    return F.coalesce((score > pivot.score) | ((score == pivot.score) & (before | same)), F.lit(False))


def _weighted_median(keys: pa.Table) -> int:
    """Row of the lower weighted median, by column n, of a table with the key's columns."""
    order = pc.sort_indices(keys, sort_keys=KEY_ORDER, null_placement="at_end").to_numpy()
    run = np.cumsum(keys.column("n").to_numpy()[order])
    return int(order[np.searchsorted(run, (run[-1] + 1) // 2)])


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each side, how many keys the task has and the weighted median of its batches' medians."""
    found: dict[bool, list[pa.Table]] = {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        for side in (True, False):
            here = table.filter(pc.equal(table.column("head"), side))
            if here.num_rows:
                at = _weighted_median(here.append_column("n", pa.array(np.ones(here.num_rows, np.int64))))
                found.setdefault(side, []).append(here.slice(at, 1).append_column("n", pa.array([here.num_rows], pa.int64())))
    for tables in found.values():
        medians = pa.concat_tables(tables)
        one = medians.slice(_weighted_median(medians), 1)
        total = pa.array([sum(medians.column("n").to_pylist())], pa.int64())
        yield from one.set_column(one.schema.get_field_index("n"), "n", total).combine_chunks().to_batches()


def cutoff(keys: DataFrame, rank: int) -> Row | None:
    """The key (score, key, row) at `rank`, 1 the first, in the order of `up_to`; None if there are fewer keys.

    A round reads the remaining keys once: each task counts its keys on either side of the pivot and offers a next pivot
    for both. So the driver sees two rows of each task and round.
    """
    remaining = keys.select("score", "key", "row")
    schema = T.StructType([*remaining.schema.fields, T.StructField("head", T.BooleanType()), T.StructField("n", T.LongType())])
    pivot, stored = None, 0
    while True:
        head = F.lit(True) if pivot is None else up_to(pivot)
        offers = remaining.withColumn("head", head).mapInArrow(_medians, schema).collect()
        ahead = sum(r.n for r in offers if r["head"])
        if pivot is None:
            stored = ahead
            if rank < 1 or rank > ahead:
                return None
        side = rank <= ahead
        if pivot is not None:
            remaining = remaining.where(up_to(pivot) if side else ~up_to(pivot))
            rank -= 0 if side else ahead
        offers = [r for r in offers if r["head"] == side]
        left = sum(r.n for r in offers)
        if left == 1:
            return offers[0]
        if left < stored * STORE_SHARE:
            remaining, stored = checkpointed(remaining), left
        table = pa.table({name: pa.array([r[name] for r in offers]) for name in ("score", "key", "row", "n")})
        pivot = offers[_weighted_median(table)]


def ranked(drawn: DataFrame) -> DataFrame:
    """Drawn keys with rank, by a sort over ranges; the first rank of each range comes from the counts of the ranges before it."""
    in_order = drawn.orderBy(F.desc("score"), F.asc_nulls_last("key"), "row").withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(in_order)
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts = np.cumsum([0, *(r.n for r in counts)])
    # One row for each range of the sort.
    first = drawn.sparkSession.createDataFrame([(r["_part"], int(s)) for r, s in zip(counts, starts, strict=False)], "_part long, _first long")
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(first), "_part").withColumn("rank", F.col("_first") + place + 1).drop("_at", "_part", "_first")


def resample(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED
) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    Drawn are `percent` of the documents of at least `least_words` words, rounded down. Null and empty texts have no words and
    weight 0. Equal scores go to the smaller key, null keys last, and rows with the same key to the one read first; each row is
    ranked on its own. Without documents there is no row; without target texts all ratios are those of an empty target.
    """
    keys = scored(docs, gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets)), key, text, seed)
    enough = F.col("n_words") >= least_words
    last = cutoff(keys.where(enough), percent * keys.where(enough).count() // 100)
    drawn = enough & up_to(last) if last else F.lit(False)
    others = keys.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    whole = others.unionByName(ranked(keys.where(drawn))) if last else others
    return whole.select(F.col("key").alias(key), "n_words", "n_features", "weight", "score", "rank")
