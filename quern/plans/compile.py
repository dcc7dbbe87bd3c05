"""Predicates, orders and cursors as Spark columns.

In a positive context Spark's own comparison is enough, since a filter drops unknown rows, and it is
pushed to the scan. Only a negated leaf needs a total form.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column as C
from pyspark.sql import functions as F

from quern.errors import Refused, refuse
from quern.functions.text_keys import key_text, utf16_order
from quern.model import ORDERABLE, Collation, Column, Constant, Kind, Unit
from quern.predicates import Always, And, Compare, ElementOf, Equal, In, Not, Or, Predicate, Range, StartsWith, Substring, validate


def literal(x: Constant) -> C:
    if x.kind is Kind.DECIMAL and x.value is not None:
        return F.lit(x.value).cast("decimal(18,4)")
    if x.kind is Kind.TIMESTAMP and x.value is not None:
        return F.lit(x.value)
    if x.kind is Kind.INT64 and x.value is not None:
        return F.lit(x.value).cast("long")
    return F.lit(x.value)


def order_key(column: Column, c: C | None = None) -> C:
    """What orders a column: text by UTF-16 units unless it is declared plain."""
    c = F.col(f"`{column.name}`") if c is None else c
    return utf16_order(c) if column.kind is Kind.STRING and not column.plain_text else c


def _bound(column: Column, x: Constant) -> C:
    if column.kind is Kind.STRING and not column.plain_text:
        return F.lit(bytearray(x.value.encode("utf-16-be")))
    return literal(x)


def to_column(p: Predicate, unit: Unit | None = None, negated: bool = False) -> C:
    """A column that is true exactly where p (or, if negated, its complement) holds; elsewhere false or null."""
    match p:
        case And(ts) | Or(ts):
            both = isinstance(p, And) != negated
            terms = [to_column(t, unit, negated) for t in ts]
            return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), terms) if terms else F.lit(both)
        case Not(t):
            return to_column(t, unit, not negated)
        case Always(v):
            return F.lit(v != negated)
        case Equal(c, x):
            if negated:
                return F.col(f"`{c.name}`").isNotNull() if x.value is None else ~F.col(f"`{c.name}`").eqNullSafe(literal(x))
    leaf = _leaf(p, unit)
    return ~F.coalesce(leaf, F.lit(False)) if negated else leaf


def _leaf(p: Predicate, unit: Unit | None) -> C:
    col = lambda c: F.col(f"`{c.name}`")
    match p:
        case Equal(c, x):
            return col(c).isNull() if x.value is None else col(c) == literal(x)
        case In(c, xs):
            if not xs:
                return F.lit(False)
            some = [literal(x) for x in xs if x.value is not None]
            out = col(c).isin(*some) if some else None
            if len(some) < len(xs):
                out = col(c).isNull() if out is None else out | col(c).isNull()
            return out
        case Range(c, lo, hi, li, ui):
            k = order_key(c)
            parts = []
            if lo is not None:
                parts.append(k >= _bound(c, lo) if li else k > _bound(c, lo))
            if hi is not None:
                parts.append(k <= _bound(c, hi) if ui else k < _bound(c, hi))
            return reduce(lambda a, b: a & b, parts)
        case StartsWith(c, prefix):
            if c.collation is not Collation.ORDINAL:
                d = next((d for d in unit.derived if d.source == c.name), None) if unit else None
                if d is None:
                    refuse("QN-QUERY-031", c.name, "no search key is stored for this column", "declare one")
                return F.col(f"`{d.name}`").startswith(key_text(prefix, d.algorithm))
            return col(c).startswith(prefix) if prefix else col(c).isNotNull()
        case Substring(c, needle, at_end):
            if not needle:
                return col(c).isNotNull()
            return F.endswith(col(c), F.lit(needle)) if at_end else F.contains(col(c), F.lit(needle))
        case ElementOf(o, xs, every):
            has = [_has(col(o), x) for x in xs]
            if every:
                return reduce(lambda a, b: a & b, has, col(o).isNotNull())
            return reduce(lambda a, b: a | b, has, F.lit(False))
        case Compare(a, op, b):
            x, y = order_key(a), order_key(b)
            return {"=": lambda: x == y, "<>": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y}[op]()
    raise TypeError(p)


def _has(owner: C, x: Constant) -> C:
    return F.exists(owner, lambda e: e.eqNullSafe(literal(x)))


@dataclass(frozen=True)
class Order:
    """A sort term; where nulls stand is always said."""

    column: Column
    descending: bool = False
    nulls_first: bool = True

    def sort(self) -> C:
        k = order_key(self.column)
        return {(False, True): k.asc_nulls_first, (False, False): k.asc_nulls_last, (True, True): k.desc_nulls_first, (True, False): k.desc_nulls_last}[(self.descending, self.nulls_first)]()


def check_orders(orders: Sequence[Order]) -> None:
    for o in orders:
        if o.column.kind not in ORDERABLE:
            refuse("QN-SEM-ORDER-001", o.column.name, f"{o.column.kind.value} has no order", "order by a declared projection")
        if o.nulls_first is None:
            refuse("QN-SEM-ORDER-002", o.column.name, "where nulls stand is not said", "say nulls first or last")


def with_tie_break(orders: Sequence[Order], unit: Unit) -> list[Order]:
    """Key columns, ascending and nulls first, after what was asked for."""
    have = {o.column.name for o in orders}
    return [*orders, *(Order(unit.column(k)) for k in unit.key if k not in have)]


def after(orders: Sequence[Order], values: Sequence[Constant]) -> C:
    """Rows that stand after the cursor: equal in the first terms, later in the next."""
    parts = []
    for i, (o, x) in enumerate(zip(orders, values, strict=True)):
        c = F.col(f"`{o.column.name}`")
        if x.value is None:
            later = c.isNotNull() if o.nulls_first else F.lit(False)
        else:
            k = order_key(o.column)
            later = k < _bound(o.column, x) if o.descending else k > _bound(o.column, x)
            if not o.nulls_first:
                later = later | c.isNull()
        same = [F.col(f"`{p.column.name}`").isNull() if v.value is None else F.col(f"`{p.column.name}`") == literal(v) for p, v in zip(orders[:i], values[:i], strict=True)]
        parts.append(reduce(lambda a, b: a & b, [*same, later]))
    return reduce(lambda a, b: a | b, parts)


def checked(p: Predicate, unit: Unit) -> Predicate:
    if found := validate(p, unit):
        raise Refused(*found)
    return p


UTC = dt.timezone.utc
