"""Exact duplicates by deterministic block naming.

Normalised texts are cut into blocks of a fixed size. Sorting the distinct blocks gives each an integer name; sorting
the distinct pairs of neighbouring names gives the pairs names, and so on until each document has one. Equal documents
have equal names and different ones differ, whatever any hash does: hashes only spread the sorting over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefield.llm import flat
from lorefield.session import checkpointed

WHITE = b" \t\n\x0b\x0c\r"
BLOCK_BYTES = 4096
NAMES_PER_TASK = 2048
PAIRS_PER_TASK = 65536

CUT = "kind int, row long, pos int, blocks int, block long, doc_id long, n_points long, sha string, content binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 for the blocks of each text and of kind 1 for the contents, each content once in a run of texts."""
    task = TaskContext.get().partitionId() << 32
    rows = blocks = 0
    for part in flat.slices(batches, "text", limit=8 << 20):
        data, bounds = flat.text_bytes(part.column(1))
        raw, points = data.tobytes(), np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        named: dict[bytes, int] = {}
        out: list[tuple] = []
        for i, doc in enumerate(part.column(0).to_pylist()):
            text = raw[bounds[i] : bounds[i + 1]].translate(None, WHITE)
            count = max(1, -(-len(text) // BLOCK_BYTES))
            for pos in range(count):
                block = named.setdefault(text[pos * BLOCK_BYTES : (pos + 1) * BLOCK_BYTES], blocks + len(named))
                first = (doc, int(points[bounds[i + 1]] - points[bounds[i]]), hashlib.sha256(text).hexdigest()) if not pos else (None,) * 3
                out.append((task + rows, pos, count, task + block, *first))
            rows += 1
        n, m = len(out), len(named)
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), *arrays, pa.nulls(n, pa.binary())], CUT_NAMES)
        numbers = pa.array(task + np.fromiter(named.values(), np.int64, m))
        empty = [pa.nulls(m, k) for k in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), *empty[:3], numbers, *empty[4:], pa.array(list(named), pa.binary())], CUT_NAMES)
        blocks += m


CUT_NAMES = [field.split(" ")[0] for field in CUT.split(", ")]


def _name(rows: DataFrame, per_task: int, *by: str) -> Column:
    """Integer names of the distinct values of `by`, from their order inside a hash bucket of about `per_task` rows."""
    buckets = max(1, -(-rows.count() // per_task))
    bucket = F.pmod(F.xxhash64(*by), F.lit(buckets))
    return F.dense_rank().over(Window.partitionBy(bucket).orderBy(*by)).cast("long") * buckets + bucket


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: the key, keep_id, group_size, kept and text_sha256 (of the normalised text).

    Texts are equal when they are the same without ASCII white space; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest id, rows without an id last; of rows alike in both one stays. No rows
    give no rows. Only the five columns come out, whatever `docs` holds besides.
    """
    rows = checkpointed(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_cut, CUT), "kind")
    contents = rows.where("kind = 1").select("block", "content")
    uses = rows.where("kind = 0")
    longest = uses.agg(F.max("blocks").alias("n")).first()["n"] or 1
    named = contents.select("block", _name(contents, NAMES_PER_TASK, "content").alias("name"))
    units = uses.select("row", "pos", "blocks", "block").join(named, "block").select("row", "pos", "blocks", "name")
    level, done = 0, []
    while longest > 1:
        units = checkpointed(units)
        done.append(units.where("blocks = 1").select("row", F.lit(level).alias("level"), "name"))
        even, odd = (F.max(F.when(F.col("pos") % 2 == side, F.col("name"))) for side in (0, 1))
        pairs = units.where("blocks > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"), F.ceil(F.col("blocks") / 2).cast("int").alias("blocks"))
        pairs = checkpointed(pairs.agg(even.alias("a"), F.coalesce(odd, F.lit(-1)).alias("b")))
        distinct = pairs.select("a", "b").distinct()
        names = distinct.select("a", "b", _name(distinct, PAIRS_PER_TASK, "a", "b").alias("name"))
        units = pairs.join(names, ["a", "b"]).select("row", "pos", "blocks", "name")
        level, longest = level + 1, -(-longest // 2)
    identity = units.select("row", F.lit(level).alias("level"), "name")
    for part in done:
        identity = identity.unionByName(part)
    about = uses.where("pos = 0").select("row", "doc_id", "n_points", "sha")
    known = checkpointed(identity.join(about, "row"))
    rank = F.struct(-F.col("n_points"), F.col("doc_id").isNull(), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    groups = known.groupBy("level", "name").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return known.join(groups, ["level", "name"]).select(
        F.col("doc_id").alias(key),
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
