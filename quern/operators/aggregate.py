"""Named aggregation profiles: closed reducers, time buckets, and budgets that refuse."""

from __future__ import annotations

import datetime as dt
import hashlib
import zoneinfo
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column as C
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.errors import Refusal, Refused, refuse
from quern.model import ORDERABLE, PLACE, RESERVED, SCOPE, Access, Constant, Kind, Unit
from quern.plans.compile import literal, order_key, to_column
from quern.predicates import TRUE, And, ElementOf, In, Not, Or, Predicate, StartsWith, canonical, validate

ROWS, GROUPS, SET_SIZE = RESERVED + "rows", RESERVED + "groups", RESERVED + "set_"
#: Fixed budgets of a source predicate.
NODES, LITERALS = 256, 1000


@dataclass(frozen=True)
class Count:
    alias: str


@dataclass(frozen=True)
class Min:
    alias: str
    column: str


@dataclass(frozen=True)
class Max:
    alias: str
    column: str


@dataclass(frozen=True)
class Sum:
    alias: str
    column: str


@dataclass(frozen=True)
class SetUnion:
    alias: str
    column: str
    max_values: int


@dataclass(frozen=True)
class FirstBy:
    """The value of the first row in an order; ties go by the key, and rows that repeat a key by their place, on frames that carry it."""

    alias: str
    column: str
    order_column: str
    descending: bool = False


@dataclass(frozen=True)
class FixedBucket:
    """UTC buckets of a width, counted from the query's origin, else its range's start, else the epoch."""

    alias: str
    column: str
    width: dt.timedelta


@dataclass(frozen=True)
class LocalDay:
    """The instant at which the local calendar day begins, in the query's zone."""

    alias: str
    column: str


@dataclass(frozen=True)
class Profile:
    name: str
    groups: tuple[Any, ...]
    aggregates: tuple[Any, ...]
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    max_groups: int = 1000
    max_input_rows: int = 100_000

    def bucket(self):
        return next((g for g in self.groups if not isinstance(g, str)), None)

    def group_aliases(self) -> list[str]:
        return [g if isinstance(g, str) else g.alias for g in self.groups]

    def aliases(self) -> list[str]:
        return self.group_aliases() + [a.alias for a in self.aggregates]


@dataclass(frozen=True)
class Having:
    """A test of one output: =, in, range or contains."""

    alias: str
    op: str
    values: tuple[Any, ...]


@dataclass(frozen=True)
class AggregateQuery:
    profile: str
    where: Predicate = TRUE
    time_from: dt.datetime | None = None
    time_to: dt.datetime | None = None
    having: tuple[Having, ...] = ()
    having_any: bool = False
    order: tuple[tuple[str, bool], ...] = ()
    take: int | None = None
    zone: str | None = None
    origin: dt.datetime | None = None


def _check(ok: bool, code: str, path: str, why: str) -> None:
    if not ok:
        refuse(code, path, why)


def validate_profile(profile: Profile, unit: Unit) -> None:
    aliases = profile.aliases()
    _check(bool(profile.name) and bool(aliases) and bool(profile.aggregates), "QN-AGG-DECL-001", profile.name, "a profile has a name and aggregates")
    _check(len(set(aliases)) == len(aliases), "QN-AGG-DECL-002", profile.name, "an alias is used twice")
    _check(profile.max_groups > 0 and profile.max_input_rows > 0, "QN-AGG-DECL-003", profile.name, "budgets are positive")
    _check(sum(not isinstance(g, str) for g in profile.groups) <= 1, "QN-AGG-DECL-004", profile.name, "one time bucket at most")
    for g in profile.groups:
        if isinstance(g, str):
            _check(unit.column(g).kind not in (Kind.JSON, Kind.DOUBLE), "QN-AGG-DECL-005", g, "this type makes no groups")
        else:
            _check(unit.column(g.column).kind is Kind.TIMESTAMP, "QN-AGG-DECL-006", g.alias, "buckets are of timestamps")
            if isinstance(g, FixedBucket):
                _check(g.width > dt.timedelta(0), "QN-AGG-DECL-007", g.alias, "a bucket has a positive width")
    for a in profile.aggregates:
        _check(not a.alias.startswith(RESERVED), "QN-AGG-DECL-008", a.alias, "the alias is reserved")
        if isinstance(a, Count):
            continue
        kind = unit.column(a.column).kind
        if isinstance(a, (Min, Max)):
            _check(kind in ORDERABLE, "QN-AGG-DECL-009", a.alias, "min and max need an order")
        elif isinstance(a, Sum):
            _check(kind in (Kind.INT32, Kind.INT64, Kind.DECIMAL), "QN-AGG-DECL-010", a.alias, "sums are of integers and decimals")
        elif isinstance(a, SetUnion):
            _check(kind is Kind.STRING and a.max_values > 0, "QN-AGG-DECL-011", a.alias, "set unions are of strings and have a limit")
        elif isinstance(a, FirstBy):
            by = unit.column(a.order_column)
            _check(by.kind in ORDERABLE and not by.nullable, "QN-AGG-DECL-012", a.alias, "first-by is ordered by a column that is not null")
    for alias, ops in profile.allowed.items():
        _check(alias in aliases and set(ops) <= {"=", "in", "range", "contains"}, "QN-AGG-DECL-013", alias, "an allowance names an output and its operators")


def _nodes(p: Predicate) -> tuple[int, int, bool]:
    """(nodes, literals, uses a predicate that aggregation refuses)."""
    match p:
        case And(ts) | Or(ts):
            parts = [_nodes(t) for t in ts]
        case Not(t):
            parts = [_nodes(t)]
        case In(_, xs):
            return 1, len(xs), False
        case StartsWith() | ElementOf():
            return 1, 1, True
        case _:
            return 1, 1, False
    return 1 + sum(x[0] for x in parts), sum(x[1] for x in parts), any(x[2] for x in parts)


def validate_query(q: AggregateQuery, profile: Profile, unit: Unit) -> None:
    if found := validate(q.where, unit):
        raise Refused(*found)
    nodes, literals, bad = _nodes(q.where)
    _check(not bad, "QN-AGG-PRED-001", "where", "prefixes and element sets are not aggregated over")
    _check(nodes <= NODES and literals <= LITERALS, "QN-AGG-PRED-002", "where", "the predicate is too large")
    sets = {a.alias for a in profile.aggregates if isinstance(a, SetUnion)}
    for h in q.having:
        _check(h.op in profile.allowed.get(h.alias, ()), "QN-AGG-PRED-003", h.alias, f"{h.op} is not allowed on it")
        _check((h.op == "contains") == (h.alias in sets), "QN-AGG-PRED-004", h.alias, "contains tests set unions, and only it does")
        _check(len(h.values) == {"=": 1, "contains": 1, "range": 2}.get(h.op, len(h.values)) and bool(h.values), "QN-AGG-PRED-005", h.alias, "the wrong number of values")
    names = [n for n, _ in q.order]
    _check(len(set(names)) == len(names) and set(names) <= set(profile.aliases()) - sets, "QN-AGG-ORDER-001", "order", "orders name outputs once, and no set union")
    _check(q.take is None or 1 <= q.take <= profile.max_groups, "QN-AGG-TAKE-001", "take", "take is between one and the group budget")
    bucket = profile.bucket()
    _check((q.zone is not None) == isinstance(bucket, LocalDay), "QN-AGG-ZONE-001", "zone", "local days, and only they, have a zone")
    if q.zone is not None:
        _check(q.zone in zoneinfo.available_timezones(), "QN-AGG-ZONE-002", q.zone, "not a zone of the IANA database")
    _check(q.origin is None or isinstance(bucket, FixedBucket), "QN-AGG-ORIGIN-001", "origin", "only fixed buckets have an origin")
    _check((q.time_from is None and q.time_to is None) or bucket is not None, "QN-AGG-RANGE-001", "time", "a time range needs a time bucket")


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def micros(t: dt.datetime) -> int:
    return (t - _EPOCH) // dt.timedelta(microseconds=1)


def fixed_bucket(ts: C, width: dt.timedelta, origin: dt.datetime | None = None) -> C:
    """The start of the bucket; before the origin too, since pmod floors."""
    us, step, start = F.unix_micros(ts), width // dt.timedelta(microseconds=1), micros(origin) if origin else 0
    return F.timestamp_micros(us - F.pmod(us - F.lit(start).cast("long"), F.lit(step).cast("long")))


def local_day(ts: C, zone: str) -> C:
    """The UTC instant of local midnight: the earliest one that exists, and the first of two. The session's zone is UTC."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, zone)), zone)


def _source(df: DataFrame, q: AggregateQuery, profile: Profile, unit: Unit, access: Access) -> DataFrame:
    if access.mode == "across":
        refuse("QN-AGG-SCOPE-001", "access", "no aggregation across scopes", "aggregate each scope")
    if access.mode == "scoped":
        df = df.where(F.col(SCOPE) == access.scope)
    if q.where != TRUE:
        df = df.where(to_column(q.where, unit))
    if (bucket := profile.bucket()) is not None:
        ts = F.col(f"`{bucket.column}`")
        df = df.where(ts.isNotNull())
        if q.time_from is not None:
            df = df.where(ts >= F.lit(q.time_from))
        if q.time_to is not None:
            df = df.where(ts < F.lit(q.time_to))
    return df


def _group_columns(q: AggregateQuery, profile: Profile) -> list[C]:
    out = []
    for g in profile.groups:
        if isinstance(g, str):
            out.append(F.col(f"`{g}`"))
        elif isinstance(g, FixedBucket):
            out.append(fixed_bucket(F.col(f"`{g.column}`"), g.width, q.origin or q.time_from).alias(g.alias))
        else:
            out.append(local_day(F.col(f"`{g.column}`"), q.zone).alias(g.alias))
    return out


def _reducer(a, unit: Unit, place: Sequence[C] = ()) -> list[C]:
    if isinstance(a, Count):
        return [F.count(F.lit(1)).alias(a.alias)]
    column = unit.column(a.column)
    c = F.col(f"`{a.column}`")
    if isinstance(a, (Min, Max)):
        if column.kind is Kind.STRING and not column.plain_text:
            by = F.min_by if isinstance(a, Min) else F.max_by
            return [by(c, order_key(column)).alias(a.alias)]
        return [(F.min if isinstance(a, Min) else F.max)(c).alias(a.alias)]
    if isinstance(a, Sum):
        return [F.sum(c.cast("long") if column.kind is not Kind.DECIMAL else c).alias(a.alias)]
    if isinstance(a, SetUnion):
        sort = lambda x, y: F.when(F.encode(x, "UTF-16BE") < F.encode(y, "UTF-16BE"), -1).when(x == y, 0).otherwise(1)
        values = F.collect_set(c)
        return [(F.array_sort(values) if column.plain_text else F.array_sort(values, sort)).alias(a.alias), F.size(values).alias(SET_SIZE + a.alias)]
    by = unit.column(a.order_column)
    keys = [*(order_key(unit.column(k)) for k in unit.key), *place]
    first = order_key(by)
    if a.descending:
        if by.kind in (Kind.INT32, Kind.INT64, Kind.DECIMAL):
            # the complement of an integer has no overflow, as its negative would
            first = F.bitwise_not(first) if by.kind is not Kind.DECIMAL else -first
        elif by.kind is Kind.TIMESTAMP:
            first = -F.unix_micros(first)
        else:
            return []  # by a window, before grouping
    return [F.min_by(c, F.struct(first.alias("o"), *(k.alias(f"k{i}") for i, k in enumerate(keys)))).alias(a.alias)]


def _windowed(df: DataFrame, profile: Profile, unit: Unit, groups: Sequence[C], place: Sequence[C]) -> tuple[DataFrame, list[C]]:
    """First-by in descending order of text or guids: rank in the group, then take the first."""
    out = []
    for a in profile.aggregates:
        if isinstance(a, FirstBy) and not _reducer(a, unit):
            rank = RESERVED + "rank_" + a.alias
            by = W.partitionBy(*groups).orderBy(order_key(unit.column(a.order_column)).desc(), *(order_key(unit.column(k)).asc() for k in unit.key), *place)
            df = df.withColumn(rank, F.row_number().over(by))
            out.append(F.min_by(F.when(F.col(rank) == 1, F.col(f"`{a.column}`")), F.col(rank)).alias(a.alias))
    return df, out


def _grouped(df: DataFrame, q: AggregateQuery, profile: Profile, unit: Unit, access: Access) -> DataFrame:
    source = _source(df, q, profile, unit, access)
    groups = _group_columns(q, profile)
    plain = [F.col(f"`{g}`") if isinstance(g, str) else c for g, c in zip(profile.groups, groups, strict=True)]
    place = [F.col(PLACE)] if PLACE in source.columns else []
    source, ranked = _windowed(source, profile, unit, plain, place)
    reducers = [c for a in profile.aggregates for c in _reducer(a, unit, place)] + ranked
    return source.groupBy(*groups).agg(*reducers, F.count(F.lit(1)).alias(ROWS))


def _having(h: Having) -> C:
    c = F.col(f"`{h.alias}`")
    lits = [F.lit(v) if not isinstance(v, Constant) else literal(v) for v in h.values]
    if h.op == "contains":
        return F.array_contains(c, lits[0])
    if h.op == "range":
        return c.between(*lits)
    return c.isin(*lits)


def _finish(grouped: DataFrame, q: AggregateQuery, profile: Profile, unit: Unit) -> DataFrame:
    if q.having:
        parts = [F.coalesce(_having(h), F.lit(False)) for h in q.having]
        grouped = grouped.where(reduce((lambda a, b: a | b) if q.having_any else (lambda a, b: a & b), parts))
    kinds = {g: unit.column(g) for g in profile.groups if isinstance(g, str)}
    kinds |= {a.alias: unit.column(a.column) for a in profile.aggregates if isinstance(a, (Min, Max, FirstBy))}
    terms = list(q.order) + [(g, False) for g in profile.group_aliases() if g not in {n for n, _ in q.order}]
    key = lambda n: order_key(kinds[n], F.col(f"`{n}`")) if n in kinds else F.col(f"`{n}`")
    if terms:
        grouped = grouped.orderBy(*(key(n).desc_nulls_last() if down else key(n).asc_nulls_first() for n, down in terms))
    if q.take:
        grouped = grouped.limit(q.take)
    return grouped.select(*(f"`{a}`" for a in profile.aliases()))


def plan(df: DataFrame, unit: Unit, profile: Profile, q: AggregateQuery, access: Access = Access()) -> DataFrame:
    """The result, lazily and without the budgets."""
    validate_profile(profile, unit)
    validate_query(q, profile, unit)
    return _finish(_grouped(df, q, profile, unit, access), q, profile, unit)


@dataclass(frozen=True)
class AggregateResult:
    rows: list[Row]
    shape_fingerprint: str
    value_fingerprint: str


def fingerprint(q: AggregateQuery, profile: Profile, access: Access, values: bool) -> str:
    parts = [profile.name, canonical(q.where, values), repr(q.order), str(q.take), repr(profile.bucket()), str(q.having_any), repr([(h.alias, h.op, h.values if values else len(h.values)) for h in q.having])]
    parts += [repr((q.time_from, q.time_to, q.zone, q.origin)), access.binding()] if values else [str(q.time_from is None), str(q.time_to is None)]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def run(df: DataFrame, unit: Unit, profile: Profile, q: AggregateQuery, access: Access = Access()) -> AggregateResult:
    """One grouped job: its rows carry the evidence for the budgets, which refuse and never cut."""
    validate_profile(profile, unit)
    validate_query(q, profile, unit)
    spark = df.sparkSession
    grouped = _grouped(df, q, profile, unit, access).limit(profile.max_groups + 1)
    try:
        held = grouped.collect()  # max_groups + 1 rows at most
    except (PySparkException, Py4JJavaError) as e:
        if any(w in str(e) for w in ("ARITHMETIC_OVERFLOW", "NUMERIC_VALUE_OUT_OF_RANGE", "overflow")):
            raise Refused(Refusal("QN-AGG-SUM-001", profile.name, "a sum overflows")) from e
        raise
    if len(held) > profile.max_groups:
        refuse("QN-AGG-BOUND-005", profile.name, f"more than {profile.max_groups} groups")
    if sum(r[ROWS] for r in held) > profile.max_input_rows:
        refuse("QN-AGG-BOUND-004", profile.name, f"more than {profile.max_input_rows} input rows")
    for a in profile.aggregates:
        if isinstance(a, SetUnion) and any(r[SET_SIZE + a.alias] > a.max_values for r in held):
            refuse("QN-AGG-BOUND-007", a.alias, f"more than {a.max_values} values")
    rows = _finish(spark.createDataFrame(held, grouped.schema), q, profile, unit).collect()
    return AggregateResult(rows, fingerprint(q, profile, access, False), fingerprint(q, profile, access, True))
