"""Rows and columns of Python values as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .. import types


def from_rows(spark: SparkSession, rows: Iterable[dict], schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """Names are those of all rows, in order of appearance; absent values are null."""
    rows = list(rows)
    if schema is None:
        names = dict.fromkeys(name for row in rows for name in row)
        schema = [(name, types.of_values(row.get(name) for row in rows)) for name in names]
    made = types.schema(schema)
    return spark.createDataFrame([tuple(types.fitted(row.get(f.name), f.dataType) for f in made) for row in rows], made)


def from_columns(spark: SparkSession, columns: dict[str, list], schema: list[tuple[str, str]] | None = None) -> DataFrame:
    if len({len(c) for c in columns.values()}) > 1:
        raise ValueError("columns differ in length")
    return from_rows(spark, [dict(zip(columns, values)) for values in zip(*columns.values())], schema or [(n, types.of_values(c)) for n, c in columns.items()])
