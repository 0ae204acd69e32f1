"""Helpers that the operators of this package share: tables, shared storage, column naming and native bitmaps."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN_DIRS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the code itself holds, as one literal: no Python rows, no files."""
    kind = StructType.fromDDL(schema)
    text = json.dumps([dict(zip(kind.names, row)) for row in rows])
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(text), f"array<{kind.simpleString()}>")))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session: texts are long, and a worker holds a batch or two of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, str(rows))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); where it is unset, a temporary one in local mode, an error elsewhere."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="quernlight-")
    return _OWN_DIRS[app]


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


WRITING = {"compression": "zstd"}


def stored(df: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage at files that outlive any executor.

    small: the table is light to compute, so tasks are joined up to the advisory size rather than kept many.
    """
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    name = "spark.sql.adaptive.coalescePartitions.parallelismFirst"
    before = spark.conf.get(name)
    if small:
        spark.conf.set(name, "false")
    try:
        df.write.options(**WRITING).parquet(path)
    finally:
        if small:
            spark.conf.set(name, before)
    made = spark.read.schema(df.schema).parquet(path)
    made.stored_path = path
    return made


def drop_stored(*frames: DataFrame) -> None:
    """Remove the files of tables that stored() made, once nothing reads them any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Words of a bitmap that are put together at once: a power of two.
PART_WORDS = 1 << 13


def bitmap_bits(n: int, bits_per_key: int = 16, most: int = 1 << 26) -> int:
    """A power of two with about bits_per_key bits a key, at most 8 MB; beyond that a bitmap only becomes less selective."""
    return min(most, 1 << max(10, math.ceil(math.log2(max(1, n) * bits_per_key))))


def bitmap_row(hashes: DataFrame, bits: int) -> DataFrame:
    """hashes: one bigint column. One row with a bitmap of `bits` bits as an array m of 64-bit words.

    The words are sums of at most bits/64 rows, so its size is bounded by `bits` whatever the input. They are put
    together in parts, so that the last task handles parts, not words.
    """
    hashes = hashes.toDF("h")
    place = F.pmod(F.col("h"), F.lit(bits))
    words = (
        hashes.select(F.shiftright(place, 6).cast("int").alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    every = hashes.sparkSession.range(0, bits // 64, 1, 1).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("b"))
    dense = words.unionAll(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    if bits > PART_WORDS * 64:
        parts = dense.groupBy(F.shiftright("w", PART_WORDS.bit_length() - 1).alias("w")).agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("b"))
        dense = parts.select("w", F.transform("b", lambda x: x["b"]).alias("b"))
    packed = dense.agg(F.array_sort(F.collect_list(F.struct("w", "b"))).alias("m")).select(F.transform("m", lambda x: x["b"]).alias("m"))
    return packed.select(F.flatten("m").alias("m")) if bits > PART_WORDS * 64 else packed


def bitmap(hashes: DataFrame, bits: int) -> Column:
    """The bitmap as a scalar subquery."""
    return bitmap_row(hashes, bits).scalar()


def in_bitmap(words: Column, h: Column, bits: int) -> Column:
    place = F.pmod(h, F.lit(bits))
    return F.getbit(F.element_at(words, (F.shiftright(place, 6) + 1).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1
