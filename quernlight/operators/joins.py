"""Join strategies and rewrites that need more knowledge than Catalyst has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's hints for the physical strategies.
HINTS = {"hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}


def join_by(strategy: str, left: DataFrame, right: DataFrame, on: Column | list[str], how: str = "inner") -> DataFrame:
    return left.join(right.hint(HINTS[strategy]), on, how)


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """left's rows of a key are dealt to `salts` tasks, and right's copied to each: for keys that AQE's skew join can't split."""
    if how not in ("inner", "left"):
        raise ValueError("a salted join is inner or left")
    names = [c for c in right.columns if c != key]
    place = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", place).join(copies, [key, "__salt"], how).select(key, *[c for c in left.columns if c != key], *names)


def eager_sum(fact: DataFrame, dim: DataFrame, key: str, by: list[str], value: str, name: str) -> DataFrame:
    """sum(value) by columns of dim, summed by key below the join: fewer rows are joined, and repeats in dim still count."""
    part = fact.groupBy(key).agg(F.sum(value).alias("__part"))
    return part.join(dim, key).groupBy(*by).agg(F.sum("__part").alias(name))


def first_match(left: DataFrame, right: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join that keeps at most one match, the first by an order."""
    rest = [c for c in right.columns if c not in keys]
    ordered = F.struct(*order, *rest) if order else F.struct(*rest)
    best = right.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("__best"))
    return left.join(best, keys, "left").select(*left.columns, *(F.col(f"__best.{c}").alias(c) for c in rest))


def mark(left: DataFrame, right: DataFrame, left_col: str, right_col: str, name: str = "mark") -> DataFrame:
    """left_col IN right_col with its three values: NULL where there is no match but a null on either side (and right has rows)."""
    facts = right.agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(right_col).isNull()).alias("__nulls"))
    hits = right.select(F.col(right_col).alias("__hit")).filter("__hit IS NOT NULL").distinct()
    seen = left.join(hits, F.col(left_col) == F.col("__hit"), "left").join(F.broadcast(facts))  # one row
    value = F.when(F.col("__n") == 0, F.lit(False)).when(F.col("__hit").isNotNull(), F.lit(True)).when(F.col(left_col).isNull() | (F.col("__nulls") > 0), F.lit(None)).otherwise(F.lit(False))
    return seen.select(*left.columns, value.alias(name))
