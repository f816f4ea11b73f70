"""Adding computed columns to record batches inside Arrow tasks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def extended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """The frame's schema with `fields` at its end; a field of the same name is replaced."""
    names = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in names] + fields)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in kept] + list(columns.values()), [*kept, *columns])


def ragged(values: pa.Array, counts) -> pa.Array:
    """Array column whose rows hold `counts` values each."""
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)
