"""How rows are dealt out to tasks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Types whose values take 8 bytes of a row, and what the sorter keeps of a row beside it (its size, and its place twice).
FIXED, BESIDE = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType), 4 + 2 * 16


def by_hash(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a key together; nulls are one key."""
    return df.repartition(n, *keys)


def by_range(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Rows of a range of keys together, ranges in order; nulls last."""
    return df.repartitionByRange(n, *(F.col(k).asc_nulls_last() for k in keys))


def round_robin(df: DataFrame, n: int) -> DataFrame:
    return df.repartition(n)


def merge_exchange(df: DataFrame, *keys: str, limit: int | None = None) -> DataFrame:
    """One order over all tasks; with a limit, each task sends only its first rows."""
    made = df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))
    return made if limit is None else made.limit(limit)


def with_partition(df: DataFrame) -> DataFrame:
    """The number of the task that holds each row."""
    return df.withColumn("partition", F.spark_partition_id())


def sorter_bytes(df: DataFrame) -> int:
    """About the memory that it takes to sort all rows at once: they are counted, and what has no fixed width is measured."""
    loose = [f.name.replace("`", "``") for f in df.schema.fields if not isinstance(f.dataType, FIXED)]
    n, *wide = df.agg(F.count(F.lit(1)), *(F.sum(F.octet_length(F.col(f"`{name}`").cast("string"))) for name in loose)).first()
    width = 8 * (-(-len(df.columns) // 64) + len(df.columns) + len(loose)) + BESIDE  # bits for nulls, columns, and loose values to whole words
    return n * width + sum(w or 0 for w in wide)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Files by key values, so that filters on the keys read only theirs."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
