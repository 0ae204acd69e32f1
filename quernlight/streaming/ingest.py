"""Batches of rows to tables, and files that keep arriving to micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import types
from ..session import scratch_path
from ..sources import in_memory

#: Rows that the driver holds before it writes them out.
MOST_HELD = 10_000


def from_batches(spark: SparkSession, batches: Iterable[list[dict]], schema: list[tuple[str, str]] | None = None) -> DataFrame:
    """The union of all batches. Without a schema names come in order of appearance, and types widen over all.

    No more than MOST_HELD rows (or one batch) are held at a time: beyond, they are written as Parquet, in a folder for
    each set of types seen so far, and read back as what the types have widened to.
    """
    held: list[dict] = []
    kinds: dict[str, str] = {}
    written: dict[tuple, str] = {}

    def seen() -> list[tuple[str, str]]:
        return schema or [(n, "string" if k == "null" else k) for n, k in kinds.items()]

    def write_out() -> None:
        key = tuple(seen())
        path = written.setdefault(key, scratch_path(spark, "batches"))
        in_memory.from_rows(spark, held, list(key)).write.mode("append").parquet(path)
        held.clear()

    for batch in batches:
        for row in batch if schema is None else ():
            for name, value in row.items():
                kinds[name] = types.wider(kinds.get(name, "null"), types.of_value(value))
        held += batch
        if len(held) >= MOST_HELD:
            write_out()
    made = in_memory.from_rows(spark, held, seen())
    for key, path in written.items():
        own, whole = dict(key), types.schema(seen())
        part = spark.read.schema(types.schema(key)).parquet(path)
        columns = [(F.col(f"`{f.name}`") if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole]
        made = made.unionAll(part.select(*columns))
    return made


def on_files(spark: SparkSession, path: str, schema, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call each(batch, number) for Parquet files under a path as they come, until all that are there are done.

    An extension: the dialect knows no streams.
    """
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
