"""Vectors as short codes: one byte per part of the vector, the number of the nearest entry in that part's codebook.

The codebooks are learned by Lloyd's rounds over resident members. A member, one part of one vector, is stored where the
owner of its (position, entry, salt) keeps its rows, and stays there while its entry does not change: a round reads the
members where they lie, sums those that stay for their owners, and only members that change their entry go through the
shuffle, to their new owner. Every round is a table in the checkpoint folder that holds its arrivals and the owners' sums.
Whether a member still lives where it once arrived follows from the few codebooks since then, so nothing is rewritten.

All arithmetic is on integers and exact, so codebooks and codes do not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.llm.arrow import ragged, with_columns
from lorefield.session import checkpointed

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Numbers of a run of rows that is worked on at a time.
RUN_NUMBERS = 1 << 20

MEMBER = "position int, entry int, salt int, part array<int>, total array<long>, count long"


@dataclass(frozen=True)
class Codebooks:
    """bounds: first component of each part, and the end; books: for each part its entries, a row of integers each."""

    bounds: tuple[int, ...]
    books: tuple[np.ndarray, ...]
    scale: int = SCALE

    @property
    def limit(self) -> int:
        return component_limit(self.bounds[-1])

    def sha256(self) -> str:
        """Digest of all entries' components by part, entry and place, as decimal numbers joined by commas."""
        return hashlib.sha256(",".join(str(x) for book in self.books for x in book.ravel().tolist()).encode()).hexdigest()


def component_limit(dimension: int) -> int:
    """Largest size of an integer component with which a vector's squared distance is sure to fit a long."""
    return min(1 << 30, math.isqrt((1 << 62) // max(dimension, 1)) // 2)


def usable(vector: Column) -> Column:
    """Whether the vector is there and all its components are finite numbers."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(odd, F.lit(True))


def integers(values: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as whole doubles, held within +-limit."""
    return np.clip(np.floor(values * scale), -limit, limit)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry, the lower one of equals, and the squared distance, both exact."""
    size = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    if 4 * size * size * max(parts.shape[1], 1) < 2**53:
        # Every product and sum is a whole number that a double holds.
        wide = book.astype(np.float64)
        ahead = (wide * wide).sum(1) - 2 * (parts @ wide.T)
        entry = ahead.argmin(1)
        return entry, (ahead[np.arange(len(parts)), entry] + (parts * parts).sum(1)).astype(np.int64)
    whole = parts.astype(np.int64)
    far = np.stack([((whole - row) ** 2).sum(1) for row in book], axis=1)
    entry = far.argmin(1)
    return entry, far[np.arange(len(parts)), entry]


def _runs(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[pa.RecordBatch]:
    step = max(1, RUN_NUMBERS // max(dimension, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _matrix(column: pa.Array, width: int, kind: type = np.float64) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(len(column), width)


def _arrivals(position: int, entry: np.ndarray, salt: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    n = len(entry)
    part = ragged(pa.array(parts.astype(np.int32).ravel()), np.full(n, parts.shape[1]))
    columns = [pa.array(np.full(n, position, np.int32)), pa.array(entry.astype(np.int32)), pa.array(salt.astype(np.int32)), part, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "part", "total", "count"])


class _Sums:
    """Sums and counts of members by (position, entry); as many as the codebooks have entries."""

    def __init__(self, widths: list[int], entries: int):
        self.total = [np.zeros((entries, w), np.int64) for w in widths]
        self.count = np.zeros((len(widths), entries), np.int64)

    def add(self, position: int, entry: np.ndarray, parts: np.ndarray, count: np.ndarray | None = None) -> None:
        np.add.at(self.total[position], entry, parts.astype(np.int64))
        np.add.at(self.count[position], entry, 1 if count is None else count)

    def batch(self, salt: int) -> pa.RecordBatch:
        position, entry = np.nonzero(self.count)
        total = pa.array([self.total[p][e].tolist() for p, e in zip(position.tolist(), entry.tolist(), strict=True)], pa.list_(pa.int64()))
        n = len(position)
        columns = [pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(np.full(n, salt, np.int32)), pa.nulls(n, pa.list_(pa.int32())), total, pa.array(self.count[position, entry])]
        return pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "part", "total", "count"])


def _deal(first: Codebooks, vector: str) -> Callable:
    """Every part of every vector as a member of its nearest entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, first.bounds[-1]):
            whole = integers(_matrix(rows.column(0), first.bounds[-1]), first.scale, first.limit)
            salt = np.asarray(rows.column(1))
            for position, book in enumerate(first.books):
                parts = whole[:, first.bounds[position] : first.bounds[position + 1]]
                yield _arrivals(position, nearest(parts, book)[0], salt, parts)

    return run


def _stay_or_go(since: list[Codebooks]) -> Callable:
    """Of members that arrived under some codebooks: those whom the last of `since` sends elsewhere, and the sums of those who
    stay. A member that an earlier one of `since` sent elsewhere lives in a later table and is passed over."""
    last = since[-1]
    widths = np.diff(last.bounds).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, task_salt = _Sums(widths, max(map(len, last.books))), 0
        for rows in _runs(batches, max(widths, default=1)):
            at = np.asarray(rows.column(0))
            for position in np.unique(at).tolist():
                here = rows.filter(pa.array(at == position))
                parts, entry, salt = _matrix(here.column(3), widths[position]), np.asarray(here.column(1)), np.asarray(here.column(2))
                for books in since[:-1]:
                    lives = nearest(parts, books.books[position])[0] == entry
                    parts, entry, salt = parts[lives], entry[lives], salt[lives]
                now, _ = nearest(parts, last.books[position])
                goes = now != entry
                sums.add(position, entry[~goes], parts[~goes])
                task_salt = int(salt[0]) if len(salt) else task_salt
                if goes.any():
                    yield _arrivals(position, now[goes], salt[goes], parts[goes])
        yield sums.batch(task_salt)

    return run


def _owned(widths: list[int], entries: int) -> Callable:
    """Sums of a round's table: its arrivals, and what owners have summed of members that stayed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(widths, entries)
        for rows in _runs(batches, max(widths, default=1)):
            at, summed = np.asarray(rows.column(0)), np.asarray(rows.column(5).is_valid())
            for position in np.unique(at).tolist():
                for kind, column in ((False, 3), (True, 4)):
                    here = rows.filter(pa.array((at == position) & (summed == kind)))
                    if here.num_rows:
                        sums.add(position, np.asarray(here.column(1)), _matrix(here.column(column), widths[position], np.int64), np.asarray(here.column(5)) if kind else None)
        yield sums.batch(0)

    return run


def _updated(members: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry as the floor of its members' mean; one without members stays."""
    widths = np.diff(books.bounds).tolist()
    partial = members.mapInArrow(_owned(widths, max(map(len, books.books))), MEMBER).select("position", "entry", "count", F.posexplode_outer("total").alias("at", "x"))
    sums = partial.groupBy("position", "entry", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("count").alias("n"))
    new = [book.copy() for book in books.books]
    # One row per component of the codebooks.
    for r in sums.where(F.col("at").isNotNull()).collect():
        new[r.position][r.entry, r["at"]] = int(r.x) // r.n
    return Codebooks(books.bounds, tuple(new), books.scale)


def train(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks of all usable vectors, or None where there is none.

    Part i of d components holds those from i*d/parts to (i+1)*d/parts, rounded down. A codebook starts as that part of the
    `entries` vectors with the smallest keys (of equal keys the smaller vector first; null keys never), or of all, if there are
    fewer; without any key there is no codebook. d is the length of the first of these; vectors of other lengths are not usable.
    """
    kept = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(usable(F.col("v")))
    first = [np.array(r.v, np.float64) for r in kept.where(F.col("key").isNotNull()).orderBy("key", "v").limit(entries).collect()]
    if not first:
        return None
    dimension = len(first[0])
    if any(len(x) != dimension for x in first):
        same = kept.where(F.col("key").isNotNull() & (F.size("v") == dimension))
        first = [np.array(r.v, np.float64) for r in same.orderBy("key", "v").limit(entries).collect()]
    bounds = tuple(i * dimension // parts for i in range(parts + 1))
    seeds = integers(np.stack(first), scale, component_limit(dimension)).astype(np.int64)
    books = Codebooks(bounds, tuple(seeds[:, a:b] for a, b in zip(bounds, bounds[1:], strict=False)), scale)

    # Even if all members of a part share one entry, its salts spread them over all tasks.
    salts = int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2 + 1
    rows = kept.where(F.size("v") == dimension).select("v", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    owner = ("position", "entry", "salt")
    arrived = [checkpointed(rows.mapInArrow(_deal(books, "v"), MEMBER).repartition(*owner))]
    past = [books, _updated(arrived[0], books)]
    for _ in range(rounds - 1):
        # past[i] assigned the arrivals of table i; the codebooks after it decide who still lives there.
        moves = [table.where(F.col("count").isNull()).mapInArrow(_stay_or_go(past[i + 1 :]), MEMBER) for i, table in enumerate(arrived)]
        whole = moves[0]
        for more in moves[1:]:
            whole = whole.union(more)
        arrived.append(checkpointed(whole.repartition(*owner)))
        past.append(_updated(arrived[-1], past[-1]))
    return past[rounds]


def encode(vectors: DataFrame, books: Codebooks | None, vector: str = "embedding") -> DataFrame:
    """The usable vectors' rows without the vector, with code (two hex digits for each part) and error, the squared distance to
    the entries as a long. Other columns stay; any of these two names are replaced. Needs no shuffle.

    Integer components are held within the books' limit, beyond which the error of some vector would not be a long. Rows with
    the same key are coded each. Without codebooks there is no usable vector, and no row.
    """
    fields = [f for f in vectors.schema.fields if f.name not in (vector, "code", "error")]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dimension, limit = books.bounds[-1], books.limit
    kept = vectors.withColumn(vector, F.col(vector).cast("array<double>")).where(usable(F.col(vector)) & (F.size(vector) == dimension))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, dimension):
            whole = integers(_matrix(rows.column(rows.num_columns - 1), dimension), books.scale, limit)
            codes, error = np.zeros((len(whole), len(books.books)), np.uint8), np.zeros(len(whole), np.int64)
            for position, book in enumerate(books.books):
                codes[:, position], far = nearest(whole[:, books.bounds[position] : books.bounds[position + 1]], book)
                error += far
            text = [row.tobytes().hex() for row in codes]
            yield with_columns(rows.select(names), {"code": pa.array(text, pa.string()), "error": pa.array(error)})

    return kept.select(*names, vector).mapInArrow(run, schema)


def group_errors(coded: DataFrame, group: str, out: str = "label_error") -> DataFrame:
    """Coded rows with the sum of errors of all rows of their group, null groups together; at most the largest long.

    Sums are made before the shuffle; the join meets one row per group, and adaptive execution splits a common one's rows.
    """
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long")
    sums = coded.groupBy(F.col(group).alias("_group")).agg(total.alias(out))
    return coded.drop(out).join(sums, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def compressed(vectors: DataFrame, key: str = "vec_id", group: str = "label", vector: str = "embedding") -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) of all usable vectors, coded by codebooks learned from them."""
    books = train(vectors, key, vector)
    coded = checkpointed(encode(vectors.select(F.col(key), F.col(group), F.col(vector)), books, vector))
    digest = F.lit(books.sha256() if books else None).cast("string")
    return group_errors(coded, group).select(key, "code", "error", "label_error", digest.alias("codebooks_sha256"))
