"""The corpus pipeline: stages that hand documents on as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernlight.llm import pipeline

STAGES = pipeline.STAGES
#: The stages learn models and draw random projections, which SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.run(spark, sf_dir, STAGES)
