"""Joins and running totals that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorefield.session import checkpointed

HOT_ROWS = 1_000_000


def lookup_join(
    rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread_by: str, how: str = "left", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Join rows to a table with one row per key, splitting each key's rows over as many tasks as its weight asks for.

    `weight` is the lookup column with the key's row count: a key of n rows gets n / `hot_rows` salts, rounded up, so
    no task has many more than `hot_rows` rows of it. The lookup is stored, so it is computed once and the planner sees
    its size. The salt comes from `spread_by`, a column of the rows, and is therefore the same when a lost task runs again.
    """
    stored = checkpointed(lookup.withColumn("_salts", F.greatest(F.lit(1), F.ceil(F.col(weight) / hot_rows)).cast("int")))
    hot = stored.where(F.col("_salts") > 1).select(key, "_salts")
    spread = F.pmod(F.xxhash64(spread_by), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_rows = rows.join(hot, key, "left").withColumn("_salt", spread).drop("_salts")
    salted_lookup = stored.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted_rows.join(salted_lookup, [key, "_salt"], how).drop("_salt")


def running(
    df: DataFrame,
    keys: list[str],
    segment: str,
    order: list[str],
    value: Column,
    out: str,
    how: str,
    exclusive: bool = False,
) -> DataFrame:
    """Running sum or maximum of `value` per key in `order`, computed in two levels.

    Rows are scanned inside (key, segment); the segment totals, which are few, are scanned per key; and the
    carry of the earlier segments is added back. No task ever holds more than one segment of a key.
    `segment` must not decrease along `order`.
    """
    fold = {"sum": F.sum, "max": F.max}[how]
    with_value = df.withColumn("_v", value)
    last = -1 if exclusive else Window.currentRow
    inside = Window.partitionBy(*keys, segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        with_value.groupBy(*keys, segment)
        .agg(fold("_v").alias("_t"))
        .withColumn("_carry", fold("_t").over(before))
        .drop("_t")
    )
    joined = with_value.withColumn("_local", fold("_v").over(inside)).join(carry, [*keys, segment], "left")
    if how == "sum":
        total = F.coalesce("_local", F.lit(0)) + F.coalesce("_carry", F.lit(0))
    else:
        total = F.greatest("_local", "_carry")
    return joined.withColumn(out, total).drop("_v", "_local", "_carry")
