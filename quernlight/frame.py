"""The lazy DataFrame API: each step binds its columns at once, and adds to a Spark plan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from . import types
from .functions import Col, col, expr
from .plans import syntax as S
from .plans.syntax import DialectError
from .plans.translate import Column, Relation, Scope, Translator, Typed, quoted

if TYPE_CHECKING:
    from .engine import Engine

#: Join types by name.
JOINS = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full", "CROSS": "cross", "SEMI": "left_semi", "ANTI": "left_anti"}


def unique(names: list[str], first: int = 1) -> list[str]:
    """Names with repeats told apart by a number."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        seen[name] = seen.get(name, first - 1) + 1
        out.append(name if seen[name] == first else f"{name}_{seen[name] - (0 if first == 1 else first)}")
    return out


class DataFrame:
    def __init__(self, engine: Engine, df: SparkFrame):
        self.engine, self.df = engine, df

    # -- binding

    def _scope(self) -> tuple[str, Scope]:
        alias = self.engine.fresh("frame")
        return alias, Scope([Relation(alias, self.schema())])

    def _bind(self, item: Col | str, scope: Scope, name: str = "") -> tuple[Typed, str]:
        made = item if isinstance(item, Col) else col(item)
        t = self.engine.translator().expression(made.node, scope)
        return t, made.name or (Translator.name(made.node, -1) if not isinstance(made.node, (S.Op, S.Literal, S.Case, S.Cast)) else name)

    def _derive(self, df: SparkFrame) -> DataFrame:
        return DataFrame(self.engine, df)

    # -- schema

    def columns(self) -> list[str]:
        return self.df.columns

    def schema(self) -> list[Column]:
        return [Column(f.name, types.of_spark(f.dataType)) for f in self.df.schema.fields]

    def explain(self) -> str:
        return self.engine.plan_text(self.df)

    def _resolve(self, name: str) -> str:
        found = [c for c in self.df.columns if c.upper() == name.upper()]
        if len(found) != 1:
            raise DialectError(f"{'ambiguous' if found else 'unknown'} column {name}")
        return found[0]

    # -- steps

    def sql(self, text: str, params: list | None = None) -> DataFrame:
        """A query over this frame, which it names self."""
        return self.engine.sql(text, params, frames={"SELF": self})

    def select(self, *items: Col | str) -> DataFrame:
        alias, scope = self._scope()
        bound = [self._bind(item, scope, f"col{i}") for i, item in enumerate(items)]
        return self._derive(self.df.alias(alias).select(*(F.expr(t.sql).alias(name) for t, name in bound)))

    def filter(self, condition: Col | str) -> DataFrame:
        alias, scope = self._scope()
        t, _ = self._bind(condition if isinstance(condition, Col) else expr(condition), scope)
        if t.type not in ("boolean", "null"):
            raise TypeError(f"a filter's condition must be boolean, not {t.type}")
        return self._derive(self.df.alias(alias).filter(F.expr(t.sql)))

    where = filter

    def with_column(self, name: str, column: Col | str) -> DataFrame:
        made = (column if isinstance(column, Col) else expr(column)).alias(name)
        kept: list[Col | str] = list(self.df.columns)
        for i, c in enumerate(self.df.columns):
            if c.upper() == name.upper():
                kept[i] = made
                return self.select(*kept)
        return self.select(*kept, made)

    def drop(self, *names: str) -> DataFrame:
        return self._derive(self.df.drop(*[self._resolve(n) for n in names]))

    def group_by(self, *items: Col | str) -> GroupedData:
        return GroupedData(self, items)

    def order_by(self, *keys: Col | str) -> DataFrame:
        """Nulls come last ascending and first descending; of chained calls the last one holds."""
        alias, scope = self._scope()
        by = []
        for key in keys:
            t, _ = self._bind(key, scope)
            e = F.expr(t.sql)
            by.append(e.desc_nulls_first() if isinstance(key, Col) and key.descending else e.asc_nulls_last())
        return self._derive(self.df.alias(alias).orderBy(*by))

    sort = order_by

    def limit(self, count: int, offset: int = 0) -> DataFrame:
        return self._derive((self.df.offset(offset) if offset else self.df).limit(count))

    def distinct(self) -> DataFrame:
        return self._derive(self.df.distinct())

    def union(self, other: DataFrame) -> DataFrame:
        """Without repeats."""
        return self.union_all(other).distinct()

    def union_all(self, other: DataFrame) -> DataFrame:
        mine, theirs = self.schema(), other.schema()
        if len(mine) != len(theirs):
            raise TypeError(f"a union needs as many columns on both sides, not {len(mine)} and {len(theirs)}")
        for i, (a, b) in enumerate(zip(mine, theirs)):
            if "null" not in (a.type, b.type) and types.group(a.type) != types.group(b.type):
                raise TypeError(f"column {i} of a union is {a.type} on one side and {b.type} on the other")
        return self._derive(self.df.unionAll(other.df))

    def join(self, other: DataFrame, on: str | list[str], how: str = "INNER") -> DataFrame:
        """On shared names: keys once (from whichever side has them), then the left's other columns in place, then the right's."""
        kind = JOINS.get(how.upper())
        if kind is None:
            raise DialectError(f"unknown join type {how}")
        keys = [on] if isinstance(on, str) else list(on)
        left, right = self.df.alias(self.engine.fresh("left")), other.df
        mine = [f"__l{i}" for i in range(len(self.df.columns))]
        theirs = [f"__r{i}" for i in range(len(other.df.columns))]
        left, right = self.df.toDF(*mine), right.toDF(*theirs)
        pairs = [(mine[self.df.columns.index(self._resolve(k))], theirs[other.df.columns.index(other._resolve(k))]) for k in keys]
        condition = None
        for a, b in pairs:
            condition = (F.col(a) == F.col(b)) if condition is None else condition & (F.col(a) == F.col(b))
        joined = left.crossJoin(right) if kind == "cross" else left.join(right, condition, kind)
        partner = dict(pairs)
        if kind in ("left_semi", "left_anti"):
            return self._derive(joined.toDF(*self.df.columns))
        out = [(F.coalesce(m, partner[m]) if m in partner else F.col(m), c) for m, c in zip(mine, self.df.columns)]
        used = set(partner.values())
        out += [(F.col(t), c) for t, c in zip(theirs, other.df.columns) if t not in used]
        return self._derive(joined.select(*(e.alias(n) for (e, _), n in zip(out, unique([c for _, c in out], 0)))))

    # -- results

    def collect(self) -> list[dict]:
        names = unique(self.df.columns)
        return [dict(zip(names, row)) for row in self.df.collect()]

    to_array = collect

    def count(self) -> int:
        return self.df.count()

    def chunks(self, size: int = 2048) -> Iterator[list[dict]]:
        """Rows in lists, fetched a partition at a time."""
        names, part = unique(self.df.columns), []
        for row in self.df.toLocalIterator(prefetchPartitions=True):
            part.append(dict(zip(names, row)))
            if len(part) == size:
                yield part
                part = []
        if part:
            yield part

    def show(self, n: int = 20) -> str:
        rows = self.limit(n).collect()
        names = unique(self.df.columns)
        cells = [["NULL" if r[c] is None else str(r[c]) for c in names] for r in rows]
        widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(names)]
        lines = [" | ".join(c.ljust(w) for c, w in zip(names, widths)), "-+-".join("-" * w for w in widths)]
        lines += [" | ".join(v.ljust(w) for v, w in zip(r, widths)) for r in cells]
        print(text := "\n".join(lines))
        return text


class GroupedData:
    def __init__(self, frame: DataFrame, items: tuple):
        self.frame, self.items = frame, items

    def agg(self, *items: Col) -> DataFrame:
        alias, scope = self.frame._scope()
        keys = [self.frame._bind(item, scope, f"col{i}") for i, item in enumerate(self.items)]
        values = [self.frame._bind(item, scope, f"col{len(keys) + i}") for i, item in enumerate(items)]
        df = self.frame.df.alias(alias)
        if not keys:
            return self.frame._derive(df.agg(*(F.expr(t.sql).alias(name) for t, name in values)))
        named = [F.expr(t.sql).alias(f"__g{i}") for i, (t, _) in enumerate(keys)]
        made = df.groupBy(*named).agg(*(F.expr(t.sql).alias(f"__a{i}") for i, (t, _) in enumerate(values)))
        out = [(f"__g{i}", n) for i, (_, n) in enumerate(keys)] + [(f"__a{i}", n) for i, (_, n) in enumerate(values)]
        return self.frame._derive(made.select(*(F.col(quoted(a)).alias(n) for a, n in out)))
