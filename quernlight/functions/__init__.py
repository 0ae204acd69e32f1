"""Column expressions that are bound late, against the frame that they are used on."""

from __future__ import annotations

from ..plans import syntax as S
from ..plans.syntax import parse_expression
from ..types import of_value


class Col:
    """An expression; operators and methods build larger ones."""

    def __init__(self, node, name: str | None = None):
        self.node, self.name, self.descending = node, name, False

    def _op(self, op: str, *others, negated: bool = False) -> Col:
        return Col(S.Op(op, [self.node, *(lit(o).node for o in others)], negated))

    def alias(self, name: str) -> Col:
        return Col(self.node, name)

    as_ = alias

    def add(self, other) -> Col:
        return self._op("+", other)

    def sub(self, other) -> Col:
        return self._op("-", other)

    def mul(self, other) -> Col:
        return self._op("*", other)

    def div(self, other) -> Col:
        return self._op("/", other)

    def mod(self, other) -> Col:
        return self._op("%", other)

    def eq(self, other) -> Col:
        return self._op("=", other)

    def ne(self, other) -> Col:
        return self._op("<>", other)

    def lt(self, other) -> Col:
        return self._op("<", other)

    def le(self, other) -> Col:
        return self._op("<=", other)

    def gt(self, other) -> Col:
        return self._op(">", other)

    def ge(self, other) -> Col:
        return self._op(">=", other)

    def and_(self, other) -> Col:
        return self._op("AND", other)

    def or_(self, other) -> Col:
        return self._op("OR", other)

    def not_(self) -> Col:
        return self._op("NOT")

    def is_null(self) -> Col:
        return self._op("IS NULL")

    def is_not_null(self) -> Col:
        return self._op("IS NULL", negated=True)

    def like(self, pattern) -> Col:
        return self._op("LIKE", pattern)

    def between(self, low, high) -> Col:
        return self._op("BETWEEN", low, high)

    def isin(self, *values) -> Col:
        return self._op("IN", *(values[0] if len(values) == 1 and isinstance(values[0], (list, tuple, set)) else values))

    def cast(self, kind: str) -> Col:
        return Col(S.Cast(self.node, kind), self.name)

    def desc(self) -> Col:
        made = Col(self.node, self.name)
        made.descending = True
        return made

    def asc(self) -> Col:
        return Col(self.node, self.name)

    __add__, __sub__, __mul__, __truediv__, __mod__ = add, sub, mul, div, mod
    __eq__, __ne__, __lt__, __le__, __gt__, __ge__ = eq, ne, lt, le, gt, ge
    __and__, __or__, __invert__ = and_, or_, not_
    __hash__ = None


def lit(value) -> Col:
    if isinstance(value, Col):
        return value
    kind = of_value(value)
    return Col(S.Literal(value if kind != "string" else str(value), kind))


def col(name: str) -> Col:
    return Col(S.Name(None, name))


def expr(text: str) -> Col:
    return Col(parse_expression(text))


def _aggregate(name: str, arg, distinct: bool = False) -> Col:
    return Col(S.Call(name, [(arg if isinstance(arg, Col) else col(arg)).node], distinct))


def sum(arg, distinct: bool = False) -> Col:  # noqa: A001
    return _aggregate("SUM", arg, distinct)


def avg(arg, distinct: bool = False) -> Col:
    return _aggregate("AVG", arg, distinct)


def min(arg) -> Col:  # noqa: A001
    return _aggregate("MIN", arg)


def max(arg) -> Col:  # noqa: A001
    return _aggregate("MAX", arg)


def count(arg, distinct: bool = False) -> Col:
    return _aggregate("COUNT", arg, distinct)


def count_star() -> Col:
    return Col(S.Call("COUNT", [], star=True))
