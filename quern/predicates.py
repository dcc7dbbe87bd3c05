"""The closed predicate algebra: a predicate is true or false for each row, never unknown."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from quern.errors import Refusal
from quern.model import EXACT_DECIMAL, ORDERABLE, Collation, Column, Constant, ElementSet, Kind, Unit


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Equal(Predicate):
    column: Column
    value: Constant


@dataclass(frozen=True)
class In(Predicate):
    column: Column
    values: tuple[Constant, ...]


@dataclass(frozen=True)
class Range(Predicate):
    column: Column
    lower: Constant | None = None
    upper: Constant | None = None
    lower_in: bool = True
    upper_in: bool = True


@dataclass(frozen=True)
class StartsWith(Predicate):
    column: Column
    prefix: str


@dataclass(frozen=True)
class Substring(Predicate):
    column: Column
    needle: str
    at_end: bool = False


@dataclass(frozen=True)
class ElementOf(Predicate):
    owner: ElementSet
    values: tuple[Constant, ...]
    every: bool = False


@dataclass(frozen=True)
class Compare(Predicate):
    left: Column
    op: str
    right: Column


@dataclass(frozen=True)
class Not(Predicate):
    term: Predicate


@dataclass(frozen=True)
class And(Predicate):
    terms: tuple[Predicate, ...]


@dataclass(frozen=True)
class Or(Predicate):
    terms: tuple[Predicate, ...]


@dataclass(frozen=True)
class Always(Predicate):
    value: bool


TRUE, FALSE = Always(True), Always(False)


def eq(column: Column, value: Any) -> Equal:
    return Equal(column, Constant.of(column, value))


def among(column: Column, values) -> In:
    return In(column, tuple(Constant.of(column, v) for v in values))


def between(column: Column, lower: Any = None, upper: Any = None, lower_in: bool = True, upper_in: bool = True) -> Range:
    bound = lambda v: None if v is None else Constant.of(column, v)
    return Range(column, bound(lower), bound(upper), lower_in, upper_in)


def element_of(owner: ElementSet, values, every: bool = False) -> ElementOf:
    return ElementOf(owner, tuple(Constant.of(owner, v) for v in values), every)


def canonical(p: Predicate, values: bool = True) -> str:
    """A stable text; without values only the shape."""
    v = (lambda c: c.text()) if values else (lambda c: "?")
    match p:
        case Equal(c, x):
            return f"eq({c.name},{v(x)})"
        case In(c, xs):
            return f"in({c.name},[{','.join(sorted(v(x) for x in xs))}])" if values else f"in({c.name},#{len(xs)})"
        case Range(c, lo, hi, li, ui):
            return f"range({c.name},{'[' if li else '('}{v(lo) if lo else '-'},{v(hi) if hi else '-'}{']' if ui else ')'})"
        case StartsWith(c, x):
            return f"starts({c.name},{x!r})" if values else f"starts({c.name},?)"
        case Substring(c, x, end):
            return f"{'ends' if end else 'contains'}({c.name},{x!r})" if values else f"{'ends' if end else 'contains'}({c.name},?)"
        case ElementOf(o, xs, every):
            return f"{'all' if every else 'any'}({o.name},[{','.join(sorted(v(x) for x in xs))}])" if values else f"{'all' if every else 'any'}({o.name},#{len(xs)})"
        case Compare(a, op, b):
            return f"cmp({a.name}{op}{b.name})"
        case Not(t):
            return f"not({canonical(t, values)})"
        case And(ts):
            return f"and({','.join(sorted(canonical(t, values) for t in ts))})"
        case Or(ts):
            return f"or({','.join(sorted(canonical(t, values) for t in ts))})"
        case Always(x):
            return "true" if x else "false"
    raise TypeError(p)


OPS: dict[str, Callable[[Any, Any], bool]] = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


def evaluate(p: Predicate, row: Mapping[str, Any]) -> bool:
    """The definition of every predicate, in Python: what compiled plans are tested against."""
    val = lambda c: Constant.of(c, row.get(c.name))
    match p:
        case Equal(c, x):
            return val(c) == x
        case In(c, xs):
            return val(c) in xs
        case Range(c, lo, hi, li, ui):
            x = val(c)
            if x.value is None:
                return False
            k = x.order_key()
            return (lo is None or (k >= lo.order_key() if li else k > lo.order_key())) and (hi is None or (k <= hi.order_key() if ui else k < hi.order_key()))
        case StartsWith(c, x):
            s = row.get(c.name)
            if s is None:
                return False
            if c.collation is not Collation.ORDINAL:
                from quern.functions.text_keys import fold

                return fold(s, c.collation).startswith(fold(x, c.collation))
            return s.startswith(x)
        case Substring(c, x, end):
            s = row.get(c.name)
            return s is not None and (s.endswith(x) if end else x in s)
        case ElementOf(o, xs, every):
            have = row.get(o.name)
            if have is None:
                return False
            own = {Constant.of(o, e) for e in have}
            return all(x in own for x in xs) if every else any(x in own for x in xs)
        case Compare(a, op, b):
            x, y = val(a), val(b)
            return x.value is not None and y.value is not None and OPS[op](x.order_key(), y.order_key())
        case Not(t):
            return not evaluate(t, row)
        case And(ts):
            return all(evaluate(t, row) for t in ts)
        case Or(ts):
            return any(evaluate(t, row) for t in ts)
        case Always(x):
            return x
    raise TypeError(p)


def columns_of(p: Predicate) -> set[str]:
    match p:
        case Equal(c) | In(c) | Range(c) | StartsWith(c) | Substring(c):
            return {c.name}
        case ElementOf(o):
            return {o.name}
        case Compare(a, _, b):
            return {a.name, b.name}
        case Not(t):
            return columns_of(t)
        case And(ts) | Or(ts):
            return set().union(*map(columns_of, ts)) if ts else set()
    return set()


def validate(p: Predicate, unit: Unit | None = None, path: str = "where", negated: bool = False) -> list[Refusal]:
    """Shapes that no plan is made for."""
    out: list[Refusal] = []
    add = lambda code, why, fix="": out.append(Refusal(code, path, why, fix))

    def exact(c: Column) -> None:
        if c.kind is Kind.DOUBLE:
            add("QN-SEM-TYPE-002", "binary floating point is not compared", "declare a decimal(18,4)")
        elif c.kind is Kind.JSON:
            add("QN-SEM-TYPE-003", "json is not compared", "declare a projected column")
        elif c.kind is Kind.DECIMAL and (getattr(c, "precision", 18), getattr(c, "scale", 4)) != EXACT_DECIMAL:
            add("QN-SEM-TYPE-004", "only decimal(18,4) is compared", "declare decimal(18,4)")
        if unit is not None and isinstance(c, Column) and unit.column(c.name).kind is not c.kind:
            add("QN-SEM-TYPE-005", f"{c.name} has another type in {unit.name}")

    def typed(c, *xs: Constant) -> None:
        if any(x.kind is not c.kind for x in xs):
            add("QN-SEM-TYPE-006", "a constant has another type than its column", "bind it to the column")

    def text(c: Column, folded: bool) -> None:
        if c.kind is not Kind.STRING:
            add("QN-SEM-TEXT-001", "text predicates need a string column")
        elif c.collation is not Collation.ORDINAL and not (folded and unit is not None and any(d.source == c.name for d in unit.derived)):
            add("QN-SEM-TEXT-002", "text is matched by its exact characters", "declare a search key and match its prefix")

    match p:
        case Equal(c, x):
            exact(c)
            typed(c, x)
        case In(c, xs):
            exact(c)
            typed(c, *xs)
            if negated and xs:
                add("QN-SEM-NOT-001", "a negated membership is not planned", "negate equalities")
        case Range(c, lo, hi):
            exact(c)
            typed(c, *(x for x in (lo, hi) if x))
            if lo is None and hi is None:
                add("QN-SEM-RANGE-001", "a range has a bound")
            if any(x is not None and x.value is None for x in (lo, hi)):
                add("QN-SEM-RANGE-002", "a bound is not null", "use equality")
            if c.kind not in ORDERABLE:
                add("QN-SEM-RANGE-003", f"{c.kind.value} has no order", "use equality or membership")
            if negated:
                add("QN-SEM-NOT-001", "a negated range is not planned", "use the complementary range")
        case StartsWith(c):
            text(c, True)
            if negated:
                add("QN-SEM-NOT-001", "a negated prefix is not planned")
        case Substring(c):
            text(c, False)
            if negated:
                add("QN-SEM-NOT-001", "a negated substring is not planned")
        case ElementOf(o, xs):
            exact(o)
            typed(o, *xs)
            if unit is not None:
                unit.element_set(o.name)
        case Compare(a, op, b):
            exact(a)
            if a.kind is not b.kind:
                add("QN-SEM-CMP-001", "compared columns have one type")
            if op not in OPS:
                add("QN-SEM-CMP-002", f"{op} compares nothing")
            elif a.kind not in ORDERABLE and op not in ("=", "<>"):
                add("QN-SEM-RANGE-003", f"{a.kind.value} has no order", "use equality")
        case Not(t):
            out += validate(t, unit, path + ".not", not negated)
        case And(ts) | Or(ts):
            for i, t in enumerate(ts):
                out += validate(t, unit, f"{path}[{i}]", negated)
    return out
