"""Row identities and training folds shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorefield.session import table


def documents(spark, base: str) -> DataFrame:
    return table(spark, base, "documents")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids fall in no fold and give null."""
    return F.crc32(doc_id.cast("string")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """True where the id's crc32 leaves `remainder`; a null id is held out, so nothing is learned from it."""
    return F.coalesce(fold(doc_id, n) == remainder, F.lit(True))
