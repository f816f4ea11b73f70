"""A stored vector index for exact cosine search: cells of similar vectors, probed in the order of what they can hold.

Every unit vector lies in the cell of its nearest centre, and a cell knows the smallest and largest angle to its centre.
By the triangle inequality that bounds the score of all its vectors, so a query reads cells in the order of their bounds
and stops when its k-th score beats the next one. Cells are folders: cells that no query asks for are never opened.

Layout below `path`: centres (cell, centre), written first; rows/batch=.../cell=... ; stats/batch=... (cell, n, near, far),
written last for each batch, so a batch whose job died is not read, and one that runs again is written over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorefield.operators.vector import DEFAULT_TOP_K, SCORE_DIGITS
from lorefield.session import checkpointed, folder_exists

MAX_CELLS = 1024
SAMPLE_PER_CELL = 16
KMEANS_ROUNDS = 8
#: A task multiplies at most this many vectors with this many queries at a time.
PART_ROWS = 8192
QUERY_BLOCK = 1024
FIRST_PROBES = 2
#: Bounds and scores are rounded doubles; a cell is passed over only if it is worse by more than this.
MARGIN = 1e-7
#: Vectors without a length stand in no direction: they have a cell of their own, and score 0.
NO_DIRECTION = -1


@dataclass
class SearchReport:
    """What a search has read: scored pairs of query and vector, rows of opened cells by round, and all rows of the index."""

    rows: int = 0
    pairs: int = 0
    opened: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class VectorIndex:
    """An opened index: as many centres and cell statistics as there are cells, and the stored rows (id, cell, unit)."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    cells: dict[int, tuple[int, float, float]]
    batches: tuple[str, ...]
    id_type: T.DataType

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    @property
    def size(self) -> int:
        return sum(n for n, _, _ in self.cells.values())

    def rows(self) -> DataFrame:
        schema = T.StructType([T.StructField("id", self.id_type), T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("angle", T.DoubleType()), T.StructField("batch", T.StringType()), T.StructField("cell", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows").where(F.col("batch").isin(*self.batches))


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), dim)


def _centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from the first rows on; a centre without members stays."""
    centres = sample[:cells].copy()
    for _ in range(KMEANS_ROUNDS if cells else 0):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = _unit(sums)
        centres = np.where((np.linalg.norm(moved, axis=1) > 0)[:, None], moved, centres)
    return centres


def _fitting(vectors: DataFrame, id_col: str, vector: str, dim: int) -> DataFrame:
    whole = vectors.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("unit"))
    return whole.where((F.size("unit") == dim) & ~F.exists("unit", lambda x: x.isNull()))


def create_index(vectors: DataFrame, path: str, dim: int, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
    """Create the index if it is not there, else open it. Rows without a vector of `dim` numbers are not indexed.

    Centres come from a sample of `SAMPLE_PER_CELL` vectors a cell, chosen by the hash of the id; all vectors are indexed. The
    number of cells is the root of the number of vectors, at most `MAX_CELLS`, unless it is given.
    """
    spark = vectors.sparkSession
    if not folder_exists(spark, f"{path}/centres/_SUCCESS"):
        kept = _fitting(vectors, id_col, vector, dim)
        cells = cells or min(MAX_CELLS, max(1, math.isqrt(kept.count())))
        chosen = kept.where(F.exists("unit", lambda x: x != 0)).orderBy(F.xxhash64(F.lit("centres"), "id"), "id").limit(cells * SAMPLE_PER_CELL)
        sample = _unit(np.array([r.unit for r in chosen.collect()], dtype=np.float64).reshape(-1, dim))
        rows = [(i, c.tolist(), vectors.schema[id_col].dataType.simpleString()) for i, c in enumerate(_centres(sample, min(cells, len(sample))))]
        spark.createDataFrame(rows or [(NO_DIRECTION, [0.0] * dim, vectors.schema[id_col].dataType.simpleString())], "cell int, centre array<double>, id_type string").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    index = open_index(spark, path)
    return index if index.batches else add_vectors(index, vectors, "first", id_col, vector)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    known = sorted(spark.read.parquet(f"{path}/centres").collect(), key=lambda r: r.cell)
    centres = np.array([r.centre for r in known if r.cell != NO_DIRECTION], dtype=np.float64).reshape(-1, len(known[0].centre))
    cells: dict[int, tuple[int, float, float]] = {}
    batches: tuple[str, ...] = ()
    if folder_exists(spark, f"{path}/stats"):
        stats = spark.read.schema("cell int, n long, near double, far double, batch string").parquet(f"{path}/stats")
        merged = stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"), F.collect_set("batch").alias("batches")).collect()
        cells = {r.cell: (r.n, r.near, r.far) for r in merged}
        batches = tuple(sorted({b for r in merged for b in r.batches}))
    return VectorIndex(spark, path, centres, cells, batches, T._parse_datatype_string(known[0].id_type))


def add_vectors(index: VectorIndex, vectors: DataFrame, batch: str, id_col: str = "vec_id", vector: str = "embedding") -> VectorIndex:
    """Put vectors into the cells of the existing centres. The same batch written again replaces itself."""
    centres, dim = index.centres, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            unit = _unit(_matrix(rows.column(1), dim))
            plain = ~unit.any(axis=1)
            if len(centres):
                score = unit @ centres.T
                cell = score.argmax(1)
                angle = np.arccos(np.clip(score[np.arange(len(unit)), cell], -1, 1))
            else:
                cell, angle = np.zeros(len(unit), np.int64), np.zeros(len(unit))
            cell = np.where(plain, NO_DIRECTION, cell).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * dim, pa.int32()), pa.array(unit.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), flat, pa.array(angle), pa.array(cell)], ["id", "unit", "angle", "cell"])

    schema = T.StructType([T.StructField("id", index.id_type), T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("angle", T.DoubleType()), T.StructField("cell", T.IntegerType())])
    placed = _fitting(vectors, id_col, vector, dim).mapInArrow(run, schema)
    # Cells are files of even size: the planner splits a large one and joins small ones.
    placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{index.path}/rows/batch={batch}")
    stored = index.spark.read.schema("angle double, cell int").parquet(f"{index.path}/rows/batch={batch}")
    stats = stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{index.path}/stats/batch={batch}")
    return open_index(index.spark, index.path)


def _bounds(cells: dict[int, tuple[int, float, float]], centres: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each query from the highest bound on, and these bounds."""
    numbers = np.array(sorted(cells), np.int64)
    bounds = np.zeros((len(unit), len(numbers)))
    real = numbers != NO_DIRECTION
    if real.any():
        _, near, far = (np.array(x) for x in zip(*(cells[int(c)] for c in numbers[real]), strict=True))
        angle = np.arccos(np.clip(unit @ centres[numbers[real]].T, -1, 1))
        bounds[:, real] = np.cos(np.maximum(0, np.maximum(angle - far, near - angle)))
    bounds[~unit.any(axis=1)] = 0.0
    order = np.argsort(-bounds, axis=1, kind="stable")
    return numbers[order], np.take_along_axis(bounds, order, 1)


def _planned(index: VectorIndex, queries: DataFrame, query_id: str, query_vector: str) -> DataFrame:
    known, centres, dim = index.cells, index.centres, index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            unit = _unit(_matrix(rows.column(1), dim))
            cells, bounds = _bounds(known, centres, unit)
            ends = lambda width: pa.array(np.arange(len(unit) + 1) * width, pa.int32())
            lists = [pa.ListArray.from_arrays(ends(x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())) for x in (unit, cells.astype(np.int32), bounds)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *lists], ["query_id", "q", "cells", "bounds"])

    fields = [T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("q", T.ArrayType(T.DoubleType())), T.StructField("cells", T.ArrayType(T.IntegerType())), T.StructField("bounds", T.ArrayType(T.DoubleType()))]
    vectors = F.col(query_vector).cast("array<double>")
    whole = queries.select(F.col(query_id).alias("query_id"), vectors.alias("v")).where(F.size("v") == index.dim)
    return checkpointed(whole.mapInArrow(run, T.StructType(fields)))


def _best(vectors: pa.Table, queries: pa.Table, k: int, dim: int) -> pa.Table:
    """The k best vectors of one part of a cell for each query that asks for it."""
    order = pc.sort_indices(vectors.column("id"))
    ids, unit = vectors.column("id").combine_chunks().take(order), _matrix(vectors.column("unit"), dim)[order.to_numpy()]
    tables = []
    for at in range(0, queries.num_rows, QUERY_BLOCK):
        block = queries.slice(at, QUERY_BLOCK)
        score = np.round(unit @ _matrix(block.column("q"), dim).T, SCORE_DIGITS) + 0.0
        # Ids ascend, so a stable sort breaks ties by id.
        top = np.argsort(-score, axis=0, kind="stable")[:k]
        names = block.column("query_id").combine_chunks().take(pa.array(np.repeat(np.arange(block.num_rows), len(top))))
        tables.append(pa.table({"query_id": names, "id": ids.take(pa.array(top.T.ravel())), "score": pa.array(np.take_along_axis(score, top, 0).T.ravel())}))
    return pa.concat_tables(tables)


def _matched(index: VectorIndex, probes: DataFrame, asked: dict[int, int], k: int, schema: T.StructType) -> DataFrame:
    """The best of every probed cell for its queries. Large cells and cells that many queries ask for are split over tasks."""
    plan = [(c, -(-index.cells[c][0] // PART_ROWS), -(-n // (4 * QUERY_BLOCK))) for c, n in asked.items()]
    # One row for each cell.
    split = F.broadcast(index.spark.createDataFrame(plan, "cell int, parts int, blocks int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows().where(F.col("cell").isin(*asked)).select("cell", "id", "unit").join(split, "cell")
    rows = rows.select("cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), every("blocks").alias("block"), "id", "unit")
    wanted = probes.join(split, "cell").select("cell", every("parts").alias("part"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "q")
    key, dim = ("cell", "part", "block"), index.dim

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": right.column("query_id").slice(0, 0), "id": left.column("id").slice(0, 0), "score": pa.array([], pa.float64())})
        return _best(left, right, k, dim)

    return rows.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInArrow(run, schema)


def search_index(index: VectorIndex, queries: DataFrame, k: int = DEFAULT_TOP_K, query_id: str = "query_id", query_vector: str = "query_vector", id_name: str = "vec_id", report: SearchReport | None = None) -> DataFrame:
    """Exact top k for every query: (query_id, vec_id, score, rank), equal scores by the smaller id.

    Each round opens the next cells of the queries that are not done, twice as many as before. Queries stay rows: only the number
    of queries at each cell comes to the driver. Queries without a vector of the index's dimension have no row.
    """
    report = report if report is not None else SearchReport()
    report.rows = index.size
    schema = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType), T.StructField("id", index.id_type), T.StructField("score", T.DoubleType())])
    frontier = _planned(index, queries, query_id, query_vector).withColumns({"at": F.lit(0), "kth": F.lit(None).cast("double")})
    best, step, order = index.spark.createDataFrame([], schema), FIRST_PROBES, Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    while index.cells:
        ahead = F.slice(F.arrays_zip("cells", "bounds"), F.col("at") + 1, F.lit(step))
        open_ = F.filter(ahead, lambda c: F.col("kth").isNull() | (c["bounds"] + MARGIN >= F.col("kth")))
        probes = checkpointed(frontier.select("query_id", "q", F.explode(open_.getField("cells")).alias("cell")))
        asked = {r["cell"]: r["n"] for r in probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not asked:
            break
        report.opened.append(sum(index.cells[c][0] for c in asked))
        report.pairs += sum(index.cells[c][0] * n for c, n in asked.items())
        hits = best.unionByName(_matched(index, probes, asked, k, schema))
        best = checkpointed(hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r"))
        kth = best.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
        later = frontier.drop("kth").withColumn("at", F.col("at") + step).join(kth, "query_id", "left")
        more = (F.col("at") < F.size("cells")) & (F.col("kth").isNull() | (F.get("bounds", F.col("at")) + MARGIN >= F.col("kth")))
        frontier, step = checkpointed(later.where(more)), 2 * step
    ranked = best.withColumn("rank", F.row_number().over(order))
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id_name), "score", "rank")
