"""Session settings, table access and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that results depend on. Sizing settings (memory, shuffle partitions) belong to the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Settings that only affect speed; applied when this package builds the session itself.
SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Narrow rows that one task sorts or groups.
ROWS_A_TASK = 250_000


def build_session(app_name: str = "lorefield", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **SPEED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def apply_semantics(spark: SparkSession) -> None:
    """Set the result-relevant options on a session built elsewhere."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)


def table(spark: SparkSession, base: str, name: str, *columns: str) -> DataFrame:
    """Read one parquet table; naming the columns keeps the scan schema narrow from the start."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def in_even_parts(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Deal a frame that grows with a table of so many rows by `keys`, into tasks of about ROWS_A_TASK of those rows.

    Left to the planner, parts are joined up to a size in bytes, which is millions of narrow rows, and what a task sorts or
    groups is many times larger in memory than in the shuffle.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def table_stream(spark: SparkSession, base: str, name: str, files: int = 64) -> DataFrame:
    """One parquet table as a stream of its files, at most `files` a batch; the table may be one file or a folder of them."""
    path = f"{base.rstrip('/')}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; a temporary one is made only for a local master."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        configured = tempfile.mkdtemp(prefix="lorefield-ckpt-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    context.setCheckpointDir(configured)
    return configured


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def checkpointed(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write the rows as a table in the checkpoint folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and not the whole history; and unlike an RDD checkpoint
    the table keeps column pruning and its real size, which the planner needs to choose joins.
    """
    path = shared_folder(df.sparkSession, "table")
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
