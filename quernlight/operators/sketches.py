"""Statistics of a table, as a planner wants them: one pass, bounded state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: list[str], buckets: int = 64, top: int = 10) -> DataFrame:
    """Rows, nulls, about how many distinct values, extremes, about equally deep buckets and frequent values, a row a column."""
    parts = []
    for c in columns:
        v = F.col(f"`{c}`")
        numeric = df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")
        bounds = F.percentile_approx(v.cast("double"), [i / buckets for i in range(buckets + 1)]) if numeric else F.lit(None).cast("array<double>")
        parts.append(
            df.agg(
                F.lit(c).alias("name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(v.isNull()).alias("n_null"),
                F.approx_count_distinct(v).alias("n_distinct"),
                F.min(v).cast("string").alias("low"),
                F.max(v).cast("string").alias("high"),
                bounds.alias("bounds"),
                F.expr(f"transform(approx_top_k(cast(`{c}` as string), {top}), x -> named_struct('value', x.item, 'n', x.count))").alias("frequent"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def correlated(a: str, b: str) -> Column:
    """Pearson's correlation of two columns, as an aggregate."""
    return F.corr(a, b)


def correlation(df: DataFrame, a: str, b: str) -> float | None:
    return df.agg(correlated(a, b)).first()[0]


def fixed_sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows, each set of n as likely as any other; the same for the same rows and seed. Each task sends n rows at most."""
    order = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in df.columns])
    return df.withColumn("__order", order).orderBy("__order").limit(n).drop("__order")


def heavy_hitters(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values of a column and their numbers, exactly, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_last()).limit(n)
