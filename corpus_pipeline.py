"""Cleaning and packing of a document corpus, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorefield.llm import decontaminate, langid, linededup, neardup, packing
from lorefield.llm.common import held_out
from lorefield.session import checkpointed, table

LEAST_SHARE = 1 / 3


def _bare(docs: DataFrame) -> DataFrame:
    """Id and text, and all other columns in one, so that none of them meets a column that an operator adds."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *rest).alias("rest"))


def _whole(rows: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of `docs`, some of them changed."""
    plain = {"doc_id": F.col("doc_id"), "text": F.col("text"), **changed}
    return rows.select(*(plain.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, a third of them or more in one learned language."""
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    judged = langid.identify(_bare(docs), model)
    return _whole(judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; n_chars follows a changed text."""
    kept = linededup.dedup_lines(_bare(docs))
    changed = F.col("n_dropped") > 0
    columns = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(changed, F.char_length("kept_text")).otherwise(F.col("rest.n_chars"))
    return _whole(kept, docs, **columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; rows that share an id stay or go together."""
    judged = neardup.near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    return docs.join(judged.where(~F.col("kept")).select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a test item."""
    found = decontaminate.contamination(_bare(docs), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _whole(found.where(F.size("spans") == 0), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("line dedup", lines),
    ("near copies", near_copies),
    ("test items", test_items),
    ("packing", packed),
]

# Language scores and similarity components have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each stored before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
