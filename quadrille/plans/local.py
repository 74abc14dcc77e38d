"""Small tables from the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}


def local_frame(spark: SparkSession, rows: Iterable[Sequence], schema: str) -> DataFrame:
    """Rows as a local relation: its size is known to the optimizer, and no Python worker reads it."""
    fields = [f.split() for f in schema.replace("`", "").split(", ")]
    rows = list(rows)
    columns = {name: pa.array([r[k] for r in rows], _TYPES[kind]) for k, (name, kind) in enumerate(fields)}
    return spark.createDataFrame(pa.table(columns))
