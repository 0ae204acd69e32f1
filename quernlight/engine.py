"""The engine: SQL text and DataFrames over one catalog."""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import redirect_stdout
from dataclasses import dataclass

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from . import types
from .catalog import Catalog, ForeignKey
from .frame import DataFrame, unique
from .operators.partitioning import sorter_bytes
from .plans import syntax as S
from .plans.eager import LEAST_ROWS
from .plans.syntax import DialectError, parse
from .plans.translate import Column, Translator
from .session import build_session
from .sources import in_memory, loaders
from .streaming import ingest

#: Memory that a task takes to sort a bucket; a table of more gets more buckets.
BUCKET_BYTES = 192 << 20


@dataclass
class Result:
    """Rows as dicts; where names repeat, row_keys tell them apart."""

    rows: list[dict]
    columns: list[str]
    row_keys: list[str]


class Cancel:
    """Stops the jobs of queries that were started with it."""

    def __init__(self):
        self.tag, self.cancelled, self._spark = f"quernlight-{uuid.uuid4().hex}", False, None

    def attach(self, spark: SparkSession) -> None:
        if self.cancelled:
            raise DialectError("the query was cancelled")
        self._spark = spark
        spark.addTag(self.tag)

    def detach(self) -> None:
        if self._spark is not None:
            self._spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.cancelled = True
        if self._spark is not None:
            self._spark.interruptTag(self.tag)


class Engine:
    def __init__(self, spark: SparkSession | None = None, eager_rows: int = LEAST_ROWS):
        """eager_rows: tables of which analyze() has counted so many rows are summed up before inner joins, where that gives the same rows."""
        self.spark, self.eager_rows = spark or build_session(), eager_rows
        self.catalog = Catalog(self.spark)
        self.functions: dict[str, tuple[str, str, int | None]] = {}
        self._count = 0

    def fresh(self, prefix: str) -> str:
        self._count += 1
        return f"__{prefix}{self._count}"

    # -- tables and functions

    def register(self, name: str, df: SparkFrame, primary_key: list[str] | None = None, foreign_keys: list[ForeignKey] | None = None) -> None:
        """A Spark DataFrame as a table."""
        self.catalog.add(name, df, primary_key, foreign_keys)

    def register_table(self, name: str, rows: Iterable[dict], schema: list[tuple[str, str]] | None = None, **keys) -> list[Column]:
        """Rows as a table; without a schema, types come from all values."""
        return self.catalog.add(name, in_memory.from_rows(self.spark, rows, schema), **keys).columns

    def register_columns(self, name: str, columns: dict[str, list], schema: list[tuple[str, str]] | None = None) -> list[Column]:
        return self.catalog.add(name, in_memory.from_columns(self.spark, columns, schema)).columns

    def register_batches(self, name: str, batches: Iterable[list[dict]], schema: list[tuple[str, str]] | None = None) -> list[Column]:
        """Batches of rows as one table; beyond a bounded number, rows are written out as they come."""
        return self.catalog.add(name, ingest.from_batches(self.spark, batches, schema)).columns

    def load(self, path: str, name: str | None = None, **options) -> str:
        """A CSV, JSON or Parquet file as a table that is named after it."""
        name = name or loaders.table_name(path)
        self.catalog.add(name, loaders.load(self.spark, path, **options))
        return name

    def register_function(self, name: str, function: Callable, returns: str = "VARCHAR", arity: int | None = None, vectorized: bool = False) -> None:
        """A scalar function for SQL text, called a row at a time over Arrow batches; with vectorized, it takes and gives pandas Series."""
        kind = types.named(returns)
        spark_name = f"quernlight_{self.catalog.number}_{name.lower()}"
        made = F.pandas_udf(function, types.SPARK[kind]) if vectorized else F.udf(function, types.SPARK[kind], useArrow=True)
        self.spark.udf.register(spark_name, made)
        self.functions[name.upper()] = (spark_name, kind, arity)

    def analyze(self, name: str) -> None:
        """Statistics of a written table (of CREATE TABLE AS or build_indexes()), which cardinalities and join order then follow."""
        e = self.catalog.entry(name)
        if e.managed:
            self.spark.sql(f"ANALYZE TABLE {e.view} COMPUTE STATISTICS FOR ALL COLUMNS")
            e.rows = self.spark.table(e.view).count()
            for setting in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
                self.spark.conf.set(setting, "true")

    def build_indexes(self, buckets: int | None = None) -> None:
        """Write every table that has a primary key in buckets by that key, each sorted by it.

        A key then reads one bucket, a range of keys skips row groups by their extremes, and tables of equally many
        buckets join on their keys without an exchange. All get as many as the largest needs for buckets of
        BUCKET_BYTES, and no fewer than asked for or than other tables have, so that tasks don't grow with the tables.
        """
        entries = [self.catalog.entry(name) for name in self.catalog.names()]
        due = [e for e in entries if e.primary_key and not e.buckets]
        needed = max((-(-sorter_bytes(self.catalog.frame(e.name)) // BUCKET_BYTES) for e in due), default=0)
        least = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        n = max(least, min(needed, int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))), *(e.buckets or 0 for e in entries))
        for e in due:
            self.catalog.add(e.name, self.catalog.frame(e.name), e.primary_key, e.foreign_keys, managed=True, buckets=n)

    # -- frames

    def table(self, name: str) -> DataFrame:
        return DataFrame(self, self.catalog.frame(name))

    def create_dataframe(self, rows: Iterable[dict], schema: list[tuple[str, str]] | None = None) -> DataFrame:
        return DataFrame(self, in_memory.from_rows(self.spark, rows, schema))

    def translator(self, params: list | None = None, frames: dict[str, DataFrame] | None = None) -> Translator:
        views: dict[str, str] = {}

        def find(name: str) -> tuple[str, list[Column]]:
            if frames and name.upper() in frames:
                if name.upper() not in views:
                    views[name.upper()] = f"quernlight_{self.catalog.number}_{self.fresh('frame')}"
                    frames[name.upper()].df.createOrReplaceTempView(views[name.upper()])
                return views[name.upper()], frames[name.upper()].schema()
            return self.catalog.find(name)

        known = lambda name, columns: name.upper() not in (frames or {}) and self.catalog.unique(name, columns)
        size = lambda name: None if name.upper() in (frames or {}) else self.catalog.entry(name).rows
        return Translator(find, self.functions, params, known, size, self.eager_rows)

    def sql(self, text: str, params: list | None = None, frames: dict[str, DataFrame] | None = None) -> DataFrame:
        """A query as a lazy frame."""
        statement = parse(text)
        if not isinstance(statement, S.Query):
            raise DialectError("sql() takes queries; run() takes other statements")
        return DataFrame(self, self._spark_frame(statement, params, frames))

    def spark_sql(self, text: str, params: list | None = None) -> str:
        """The Spark SQL that a query becomes."""
        return self.translator(params).query(parse(text)).sql

    def _spark_frame(self, q: S.Query, params: list | None, frames: dict[str, DataFrame] | None = None) -> SparkFrame:
        made = self.translator(params, frames).query(q)
        return self.spark.sql(made.sql)

    # -- statements

    def run(self, text: str, params: list | None = None, signal: Cancel | None = None) -> Result:
        statement = parse(text)
        if isinstance(statement, S.CreateTable):
            return self._create(statement, params)
        if isinstance(statement, S.DropTable):
            if statement.name not in self.catalog and statement.if_exists:
                return Result([], [], [])
            self.catalog.drop(statement.name)
            return Result([], [], [])
        if signal:
            signal.attach(self.spark)
        try:
            if isinstance(statement, S.Explain):
                df = self._spark_frame(statement.query, params)
                name, text = ("EXPLAIN_ANALYZE", self._analyzed(df)) if statement.analyze else ("EXPLAIN_PLAN", self.plan_text(df))
                return Result([{name: text}], [name], [name])
            df = self._spark_frame(statement, params)
            keys = unique(df.columns)
            return Result([dict(zip(keys, row)) for row in df.collect()], df.columns, keys)
        finally:
            if signal:
                signal.detach()

    def stream(self, text: str, params: list | None = None, size: int = 2048) -> Iterator[list[dict]]:
        """Rows in lists; a caller that stops early stops the query."""
        cancel = Cancel()
        cancel.attach(self.spark)
        try:
            yield from self.sql(text, params).chunks(size)
        finally:
            cancel.cancel()
            cancel.detach()

    def _create(self, s: S.CreateTable, params: list | None) -> Result:
        if s.name in self.catalog:
            if s.if_not_exists:
                return Result([], [], [])
            raise DialectError(f"table {s.name} exists")
        names = [n for n, _ in s.columns] if s.columns is not None else None
        df = self.spark.createDataFrame([], types.schema(s.columns)) if s.query is None else self._spark_frame(s.query, params)
        names = names or df.columns
        if len({n.upper() for n in names}) < len(names):
            raise DialectError(f"two columns of {s.name} have one name")
        self.catalog.add(s.name, df, managed=s.query is not None)
        return Result([], [], [])

    # -- plans

    @staticmethod
    def plan_text(df: SparkFrame) -> str:
        with redirect_stdout(out := io.StringIO()):
            df.explain("formatted")
        return out.getvalue()

    def _analyzed(self, df: SparkFrame) -> str:
        """Run to a sink that keeps nothing, counting rows on the way."""
        seen = Observation()
        began = time.perf_counter()
        df.toDF(*[f"c{i}" for i in range(len(df.columns))]).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        took = (time.perf_counter() - began) * 1000
        return f"{self.plan_text(df)}\nExecution Time: {took:.2f} ms\nRows Returned: {seen.get['n']}"
