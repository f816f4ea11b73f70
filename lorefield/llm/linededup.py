"""Line deduplication over levelled sorted runs of line hashes.

Batches of documents come in the order of their ids. The hashes of a batch are merge-anti-joined with every stored run;
what is new becomes a run of its own, sorted and bucketed by hash, with the id of the document that holds it. When a
level has `fanout` runs they are merged into one run of the next level. A line stays where its document owns its hash.
Everything is DataFrame work; no Python runs on the executors.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.session import checkpointed, shared_folder

WHITE = " \t\n\x0b\x0c\r"
MIN_KEY = 10
BATCHES = 4
FANOUT = 3
LAST_ID = (1 << 63) - 1


class RunStore:
    """Sorted runs of (h1, h2, owner), each hash in exactly one run; a run is a table bucketed by hash in shared storage."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark = spark
        self.fanout = fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", shared_folder(self.spark, "run")
        spread = rows.repartition(self.buckets, "h1", "h2")
        spread.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))

    def _runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, keys: DataFrame) -> None:
        """Store the hashes of a batch, one row each, that no earlier batch has; merge levels that are full."""
        fresh = keys
        for name, _ in self._runs():
            fresh = fresh.join(self.spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        self._write(fresh, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._write(reduce(DataFrame.unionByName, [self.spark.table(name) for name, _ in full]), level + 1)
            self._forget(full)
            level += 1

    def _forget(self, runs: list[tuple[str, str]]) -> None:
        for name, _ in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def owners(self) -> DataFrame:
        """All hashes with their owners, from the run files; the tables' names are given up."""
        runs = self._runs()
        self._forget(runs)
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(*(path for _, path in runs))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, with A-Z in lower case and all else as it is."""
    bare = F.btrim(line, F.lit(WHITE))
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, upper, upper.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_key: int = MIN_KEY, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """`docs` with n_lines, n_dropped and kept_text.

    A null or empty text is one empty line. A line whose key has at least `min_key` code points stays only in the
    smallest `key` that holds it, as often as it stands there. Rows with the same id are one document; rows without an
    id count as one document with the largest id. With no rows nothing comes out. Columns of the three names are replaced.
    """
    spark = docs.sparkSession
    own_id = F.coalesce(F.col(key).cast("long"), F.lit(LAST_ID))
    row_hash = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    cuts = docs.agg(F.percentile_approx(own_id, F.array(*(F.lit(i / batches) for i in range(1, batches))), 1000).alias("c")).first()["c"] or []
    batch = reduce(lambda n, c: n + (F.col("_doc") > c).cast("int"), cuts, F.lit(0))
    exploded = docs.select(own_id.alias("_doc"), row_hash.alias("_row"), F.posexplode(_lines(F.col(text))).alias("_pos", "_line"))
    bare = line_key(F.col("_line"))
    hashed = exploded.where((F.octet_length("_line") >= min_key) & (F.char_length(bare) >= min_key)).select(
        "_doc", "_row", "_pos", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("second"), bare).alias("h2"), batch.alias("_batch")
    )
    stored = checkpointed(hashed, "_batch")
    store = RunStore(spark, fanout)
    for number in range(len(set(cuts)) + 1):
        here = stored.where(F.col("_batch") == sum(cuts.count(c) for c in sorted(set(cuts))[:number]))
        store.add(here.groupBy("h1", "h2").agg(F.min("_doc").alias("owner")))
    owned = store.owners().withColumnRenamed("owner", "_doc")
    lost = stored.join(owned.hint("merge"), ["h1", "h2", "_doc"], "left_anti").groupBy("_doc", "_row").agg(F.collect_set("_pos").alias("_lost"))
    given = docs.select(F.struct("*").alias("_given"), own_id.alias("_doc"), row_hash.alias("_row")).join(lost, ["_doc", "_row"], "left")
    lines = given.select("_given", F.coalesce("_lost", F.array().cast("array<int>")).alias("_lost"), _lines(F.col("_given")[text]).alias("_lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
    return lines.select(
        *(F.col("_given")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped", "kept_text")),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size("_lost").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.col("_lines")[i]), "\n").alias("kept_text"),
    )
