"""Tables of an engine: names without regard to case, their views in the session, keys, and a version."""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import types
from .plans.syntax import DialectError
from .plans.translate import Column

_ENGINES = itertools.count(1)


@dataclass
class ForeignKey:
    columns: list[str]
    table: str
    references: list[str]


@dataclass
class Entry:
    name: str
    view: str
    columns: list[Column]
    primary_key: list[str] = field(default_factory=list)
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    managed: bool = False
    buckets: int | None = None
    rows: int | None = None  # as counted by analyze()


class Catalog:
    """Each engine's views carry its number, so that engines of one session don't meet."""

    def __init__(self, spark: SparkSession):
        self.spark, self.number, self.version = spark, next(_ENGINES), 0
        self._entries: dict[str, Entry] = {}

    def __contains__(self, name: str) -> bool:
        return name.upper() in self._entries

    def names(self) -> list[str]:
        return [e.name for e in self._entries.values()]

    def entry(self, name: str) -> Entry:
        if name not in self:
            raise DialectError(f"unknown table {name}")
        return self._entries[name.upper()]

    def find(self, name: str) -> tuple[str, list[Column]]:
        e = self.entry(name)
        return e.view, e.columns

    def frame(self, name: str) -> DataFrame:
        return self.spark.table(self.entry(name).view)

    def add(self, name: str, df: DataFrame, primary_key: list[str] | None = None, foreign_keys: list[ForeignKey] | None = None, managed: bool = False, buckets: int | None = None) -> Entry:
        """Register a DataFrame under a name; with managed, its rows are written to a table that DROP removes, in buckets by its key if so many are given."""
        part = uuid.uuid4().hex[:12] if managed else f"v{self.version}"  # a table's files may outlive the session
        view = f"quernlight_{self.number}_{part}_{''.join(c if c.isalnum() and c.isascii() else '_' for c in name.lower())}"
        if managed:
            writer = df.repartition(buckets, *primary_key).write.bucketBy(buckets, *primary_key).sortBy(*primary_key) if buckets else df.write
            writer.format("parquet").saveAsTable(view)
            df = self.spark.table(view)
        else:
            df.createOrReplaceTempView(view)
        if name in self:
            self.drop(name)
        e = Entry(name, view, [Column(f.name, types.of_spark(f.dataType)) for f in df.schema.fields], list(primary_key or []), list(foreign_keys or []), managed, buckets)
        self._entries[name.upper()] = e
        self.version += 1
        return e

    def drop(self, name: str) -> None:
        e = self.entry(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {e.view}") if e.managed else self.spark.catalog.dropTempView(e.view)
        del self._entries[name.upper()]
        self.version += 1

    def unique(self, name: str, columns: list[str]) -> bool:
        """Whether the columns include the table's primary key."""
        key = self.entry(name).primary_key
        return bool(key) and {k.upper() for k in key} <= {c.upper() for c in columns}
