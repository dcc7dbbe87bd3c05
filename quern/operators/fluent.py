"""A fluent front end: column proxies that build the closed algebra, and refuse everything else."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame

from quern.errors import refuse
from quern.model import ORDERABLE, Access, Column, Kind, Unit
from quern.plans import query as plans
from quern.plans.compile import Order
from quern.predicates import FALSE, TRUE, And, Compare, Not, Predicate, StartsWith, Substring, among, between, element_of, eq

_COMPUTED = "declare a computed column; expressions over columns are not planned"


class Part:
    """A date part of a timestamp, which only equality tests: it becomes a range."""

    def __init__(self, column: Column, part: str):
        self.column, self.part = column, part

    def __eq__(self, value: Any) -> Predicate:  # type: ignore[override]
        utc = dt.timezone.utc
        if self.part == "year":
            return between(self.column, dt.datetime(value, 1, 1, tzinfo=utc), dt.datetime(value + 1, 1, 1, tzinfo=utc), True, False)
        start = dt.datetime(value.year, value.month, value.day, tzinfo=utc)
        return between(self.column, start, start + dt.timedelta(days=1), True, False)

    def _other(self, _: Any) -> Predicate:
        refuse("QN-FLUENT-101", self.column.name, "a date part is only tested for equality", "use a range")

    __ne__ = __lt__ = __le__ = __gt__ = __ge__ = _other  # type: ignore[assignment]
    __hash__ = None  # type: ignore[assignment]


class Proxy:
    """Stands for a column in predicates."""

    def __init__(self, unit: Unit, column: Column):
        self.unit, self.column = unit, column

    def _with(self, op: str, value: Any) -> Predicate:
        if isinstance(value, Proxy):
            return Compare(self.column, op, value.column)
        if self.column.kind is Kind.TIMESTAMP and isinstance(value, dt.datetime) and value.tzinfo is None:
            refuse("QN-FLUENT-109", self.column.name, "a time without an offset", "use a time in UTC")
        if op == "=":
            return eq(self.column, value)
        if op == "<>":
            return Not(eq(self.column, value))
        return {">": lambda: between(self.column, value, None, False), ">=": lambda: between(self.column, value), "<": lambda: between(self.column, None, value, True, False), "<=": lambda: between(self.column, None, value)}[op]()

    def __eq__(self, v: Any) -> Predicate:  # type: ignore[override]
        return self._with("=", v)

    def __ne__(self, v: Any) -> Predicate:  # type: ignore[override]
        return self._with("<>", v)

    def __lt__(self, v: Any) -> Predicate:
        return self._with("<", v)

    def __le__(self, v: Any) -> Predicate:
        return self._with("<=", v)

    def __gt__(self, v: Any) -> Predicate:
        return self._with(">", v)

    def __ge__(self, v: Any) -> Predicate:
        return self._with(">=", v)

    __hash__ = None  # type: ignore[assignment]

    def isin(self, values: Iterable[Any]) -> Predicate:
        return among(self.column, values)

    def between(self, lower: Any, upper: Any) -> Predicate:
        return between(self.column, lower, upper)

    def startswith(self, prefix: str) -> Predicate:
        return StartsWith(self.column, prefix)

    def contains(self, needle: str) -> Predicate:
        return Substring(self.column, needle)

    def endswith(self, needle: str) -> Predicate:
        return Substring(self.column, needle, True)

    def has_value(self) -> Predicate:
        return Not(eq(self.column, None))

    @property
    def year(self) -> Part:
        return Part(self.column, "year")

    @property
    def date(self) -> Part:
        return Part(self.column, "date")

    def lower(self, *_: Any):
        refuse("QN-FLUENT-101", self.column.name, _COMPUTED)

    upper = length = lower

    def _arithmetic(self, _: Any):
        refuse("QN-FLUENT-102", self.column.name, _COMPUTED)

    __add__ = __sub__ = __mul__ = __truediv__ = __mod__ = __radd__ = __rsub__ = __rmul__ = _arithmetic

    def __bool__(self) -> bool:
        refuse("QN-FLUENT-107", self.column.name, "a predicate is not a Python truth value", "combine with &, | and ~")

    def order(self, descending: bool = False) -> Order:
        """Ascending with nulls last, descending with nulls first, as this front end has it."""
        if self.column.kind not in ORDERABLE:
            refuse("QN-SEM-ORDER-001", self.column.name, "has no order")
        return Order(self.column, descending, descending)


class SetProxy:
    def __init__(self, unit: Unit, name: str):
        self.owner = unit.element_set(name)

    def has_element(self, value: Any) -> Predicate:
        return element_of(self.owner, [value])

    def any_of(self, values: Iterable[Any]) -> Predicate:
        return element_of(self.owner, list(values))

    def all_of(self, values: Iterable[Any]) -> Predicate:
        return element_of(self.owner, list(values), every=True)


class Rows:
    """Attribute access to a unit's columns and element sets."""

    def __init__(self, unit: Unit):
        self._unit = unit

    def __getattr__(self, name: str):
        if name in {e.name for e in self._unit.element_sets}:
            return SetProxy(self._unit, name)
        return Proxy(self._unit, self._unit.column(name))

    __getitem__ = __getattr__


class Table:
    """Immutable: every step returns another query."""

    def __init__(self, unit: Unit, df: DataFrame | None = None, access: Access = Access(), _query: plans.Query | None = None):
        self.unit, self.df, self.access = unit, df, access
        self.query = _query or plans.Query(unit)
        self.row = Rows(unit)

    def _but(self, **changes: Any) -> Table:
        return Table(self.unit, self.df, self.access, replace(self.query, **changes))

    def where(self, p: Predicate | Callable[[Rows], Predicate]) -> Table:
        p = p if isinstance(p, Predicate) else p(self.row)
        if not isinstance(p, Predicate):
            refuse("QN-FLUENT-107", "where", "not a predicate", "return one from the fragment")
        old = self.query.where
        return self._but(where=p if old == TRUE else And((old, p)))

    def where_if(self, condition: bool, p: Predicate | Callable[[Rows], Predicate]) -> Table:
        return self.where(p) if condition else self

    def none(self) -> Table:
        return self._but(where=FALSE)

    def order_by(self, *columns: str | Proxy, descending: bool = False) -> Table:
        proxies = [c if isinstance(c, Proxy) else self.row[c] for c in columns]
        return self._but(order=tuple(p.order(descending) for p in proxies))

    def then_by(self, column: str | Proxy, descending: bool = False) -> Table:
        p = column if isinstance(column, Proxy) else self.row[column]
        return self._but(order=(*self.query.order, p.order(descending)))

    def skip(self, n: int) -> Table:
        return self._but(page=replace(self.query.page, offset=n))

    def take(self, n: int) -> Table:
        return self._but(page=replace(self.query.page, limit=n))

    def keyset(self, n: int, token: str | None = None) -> Table:
        return self._but(page=plans.Page(n, 0, True, token))

    def select(self, *columns: str) -> Table:
        if any(not isinstance(c, str) for c in columns):
            refuse("QN-FLUENT-101", "select", _COMPUTED)
        return self._but(columns=tuple(columns))

    def latest_per(self, key: str, timestamp: str) -> Table:
        return self._but(latest=plans.Latest(self.unit.column(key), self.unit.column(timestamp)))

    def accept_scan(self, id: str, reason: str, owner: str, expires: dt.date) -> Table:
        return self._but(accepted_scan=plans.Scan(id, reason, owner, expires))

    def join(self, *_: Any, **__: Any):
        refuse("QN-FLUENT-104", "join", "there are no joins", "use a declared element set or two queries")

    def group_by(self, *_: Any, **__: Any):
        refuse("QN-FLUENT-105", "group_by", "there is no free grouping", "use latest_per() or a declared profile")

    def to_df(self) -> DataFrame:
        return plans.plan(self.df, self.query, self.access)

    def to_list(self) -> plans.Result:
        return plans.run(self.df, self.query, self.access)

    def count(self) -> int:
        return plans.count(self.df, self.query, self.access)

    def any(self) -> bool:
        return plans.any_row(self.df, self.query, self.access)
