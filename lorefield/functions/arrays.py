"""Running folds over arrays that stay inside one row, so no shuffle is needed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Appending to an accumulator array copies it. Folding in blocks keeps the copies short,
# which makes the cost close to linear even for very long arrays.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Compute `value` once and use it many times in `body`.

    An expression named by `withColumn` may be inlined by the optimizer, and is then computed again for each
    element when it is used inside a higher-order function. A lambda variable never is.
    """
    return F.transform(F.array(value), body).getItem(0)


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """`let` for several values at once."""
    named = F.struct(*[value.alias(f"v{i}") for i, value in enumerate(values)])
    return let(named, lambda s: body(*[s[f"v{i}"] for i in range(len(values))]))


def scan(items: Column, zero: Column, out_type: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Left-to-right scan: `step(state, item)` gives (output, next state); the outputs come back in order.

    `zero` is the starting state and `out_type` the SQL type of one output.
    """
    empty = F.expr(f"cast(array() as array<{out_type}>)")
    empty_blocks = F.expr(f"cast(array() as array<array<{out_type}>>)")

    def one(acc: Column, item: Column) -> Column:
        output, state = step(acc["state"], item)
        return F.struct(F.concat(acc["out"], F.array(output)).alias("out"), state.alias("state"))

    def run(xs: Column) -> Column:
        def block(acc: Column, index: Column) -> Column:
            part = F.slice(xs, index * BLOCK + 1, F.lit(BLOCK))
            inner = F.aggregate(part, F.struct(empty.alias("out"), acc["state"].alias("state")), one)
            return let(
                inner,
                lambda r: F.struct(
                    F.concat(acc["blocks"], F.array(r["out"])).alias("blocks"), r["state"].alias("state")
                ),
            )

        count = F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int"), F.lit(1))
        start = F.struct(empty_blocks.alias("blocks"), zero.alias("state"))
        return F.flatten(F.aggregate(F.sequence(F.lit(0), count - 1), start, block)["blocks"])

    return let(items, run)


def offsets(pieces: Column) -> Column:
    """Start offset of each string when the strings lie end to end."""
    return scan(pieces, F.lit(0), "int", lambda at, piece: (at, at + F.length(piece)))


def explode_rows(df: DataFrame, array: Column, *keep: str, pos: str = "pos", item: str = "item") -> DataFrame:
    """(keep, pos, item) per element; `pos` counts from 0.

    A plain explode makes the optimizer test the array for elements first, which would compute a costly array twice;
    the outer form with a test on its output computes it once.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())


def set_union(left: Column, right: Column) -> Column:
    empty = F.expr("cast(array() as array<string>)")
    return F.array_sort(F.array_union(F.coalesce(left, empty), F.coalesce(right, empty)))


def keep_truthy(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: v.isNotNull() & (v != ""))


def overlay(base: Column, update: Column) -> Column:
    """Map union in which the second map wins; needs the LAST_WIN map policy set by the session."""
    return F.map_concat(base, update)
