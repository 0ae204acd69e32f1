"""Files as DataFrames, by their extension.

Files are read by Spark's readers, in parallel and from any store. CSV has a header; types are inferred from a sample of
rows, values that don't fit become null, and dates stay text. A CSV file is split between tasks unless a quoted field
holds a line break somewhere. JSON is an array of objects or an object a line.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_ROWS = 1000


def table_name(path: str) -> str:
    return posixpath.basename(path.rstrip("/")).rsplit(".", 1)[0]


def _guess(values: list[str]) -> T.DataType:
    """The narrowest type that every sampled value reads as."""
    found = [v.strip() for v in values if v is not None and v.strip()]
    if not found:
        return T.StringType()
    if all(v.lower() in ("true", "false") for v in found):
        return T.BooleanType()
    if all(re.fullmatch(r"[+-]?\d{1,18}", v) for v in found):
        return T.IntegerType() if all(-(2**31) <= int(v) < 2**31 for v in found) else T.LongType()
    if all(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", v) for v in found):
        return T.DoubleType()
    return T.StringType()


def _breaks_in_fields(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field goes on in the next line: then a line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).filter(quotes % 2 == 1).isEmpty()


def _numbered(df: DataFrame, columns: list) -> DataFrame:
    """The columns and "__place", a row's number in its file order, from the number of rows in each part of a file."""
    part = {"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()}
    placed = df.select(*columns, *[c.alias(name) for name, c in part.items()])
    parts = placed.groupBy("__file", "__at").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__at").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part of a file
    starts = parts.select("__file", "__at", (F.coalesce(before, F.lit(0)) - F.col("__low")).alias("__start"))
    return placed.join(starts, ["__file", "__at"]).withColumn("__place", F.col("__id") + F.col("__start")).drop(*part, "__start")


def csv(spark: SparkSession, path: str, max_rows: int | None = None, partition: tuple[int, int] | None = None) -> DataFrame:
    """partition: (index, count) keeps the rows whose place in the file, modulo count, is index."""
    text = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=_breaks_in_fields(spark, path), escape='"')
    sample = text.limit(SAMPLE_ROWS).collect()  # a bounded sample, for types alone
    out = []
    for i, name in enumerate(text.columns):
        kind, value = _guess([row[i] for row in sample]), F.trim(F.col(f"`{name}`"))
        out.append((F.col(f"`{name}`") if isinstance(kind, T.StringType) else F.when(value != "", value).try_cast(kind)).alias(name))
    df = text.select(*out)
    if partition is not None:
        index, count = partition
        df = _numbered(text, out).filter(F.col("__place") % count == index).drop("__place")
    return df.limit(max_rows) if max_rows is not None else df


def json(spark: SparkSession, path: str) -> DataFrame:
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not first:
        raise ValueError(f"{path} holds no rows")
    df = spark.read.option("multiLine", first[0][0].lstrip().startswith("[")).json(path)
    # nested values are kept as their text
    return df.select(*(F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return csv(spark, path, **options)
    if kind == "json":
        return json(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"no loader for .{kind} files")
