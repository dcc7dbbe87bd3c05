"""Requests and their plans: filter, latest per key, order, page, count."""

from __future__ import annotations

import base64
import datetime as dt
import decimal
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.errors import refuse
from quern.model import RESERVED, SCOPE, Access, Column, Constant, Kind, Unit
from quern.normalize import normalize
from quern.plans.compile import Order, after, check_orders, checked, to_column, with_tie_break
from quern.predicates import TRUE, Predicate, canonical

#: Fixed budgets of a request.
MOST_VALUES, MOST_PARAMETERS = 1000, 2100
SCOPE_TOKEN = RESERVED + "scope_token"


@dataclass(frozen=True)
class Page:
    """limit rows: from an offset, or after a continuation token (keyset)."""

    limit: int | None = None
    offset: int = 0
    keyset: bool = False
    token: str | None = None

    def __post_init__(self):
        if self.limit is not None and self.limit <= 0 or self.offset < 0 or (self.keyset and self.offset):
            refuse("QN-QUERY-001", "page", "a page has a positive limit, and an offset that is not negative")


@dataclass(frozen=True)
class Latest:
    key: Column
    timestamp: Column


@dataclass(frozen=True)
class Scan:
    """An accepted scan: who answers for it, why, and until when."""

    id: str
    reason: str
    owner: str
    expires: dt.date


@dataclass(frozen=True)
class Query:
    unit: Unit
    where: Predicate = TRUE
    order: tuple[Order, ...] = ()
    columns: tuple[str, ...] = ()
    page: Page = field(default_factory=Page)
    total_count: bool = False
    latest: Latest | None = None
    accepted_scan: Scan | None = None

    def __post_init__(self):
        checked(self.where, self.unit)
        check_orders(self.order)
        for c in self.columns:
            if c not in self.unit.visible():
                self.unit.column(c)
        if self.latest and (self.latest.timestamp.nullable or self.latest.timestamp.kind is not Kind.TIMESTAMP):
            refuse("QN-SEM-LATEST-001", self.latest.timestamp.name, "latest needs a timestamp that is not null", "declare one")

    @property
    def normal(self) -> Predicate:
        return normalize(self.where)

    def _text(self, values: bool) -> str:
        order = ",".join(f"{o.column.name}{'-' if o.descending else '+'}{'f' if o.nulls_first else 'l'}" for o in self.order)
        latest = f"{self.latest.key.name}/{self.latest.timestamp.name}" if self.latest else ""
        return "|".join([self.unit.name, canonical(self.normal, values), order, ",".join(self.columns), latest, str(self.total_count)])

    def fingerprint(self, values: bool = True) -> str:
        """Of the request without its page; without values, of its shape."""
        return hashlib.sha256(self._text(values).encode()).hexdigest()


# continuation tokens

_PREFIX = "k2."


def _plain(x: Constant) -> Any:
    v = x.value
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.hex() if isinstance(v, bytes) else v


def _bound(column: Column, v: Any) -> Constant:
    if v is not None and column.kind is Kind.TIMESTAMP:
        v = dt.datetime.fromisoformat(v)
    elif v is not None and column.kind is Kind.DECIMAL:
        v = decimal.Decimal(v)
    return Constant.of(column, v)


def encode_token(query: Query, orders: Sequence[Order], access: Access, values: Sequence[Constant]) -> str:
    body = {"q": query.fingerprint(), "a": access.binding(), "o": [o.column.name for o in orders], "v": [_plain(x) for x in values]}
    raw = json.dumps(body, sort_keys=True, separators=(",", ":")).encode()
    return _PREFIX + base64.urlsafe_b64encode(hashlib.sha256(raw).digest()[:8] + raw).decode().rstrip("=")


def decode_token(token: str, query: Query, orders: Sequence[Order], access: Access) -> list[Constant]:
    def bad(why: str):
        refuse("QN-TOKEN-001", "token", why, "start from the first page")

    if not token.startswith(_PREFIX):
        bad("not a token of this version")
    try:
        raw = base64.urlsafe_b64decode(token[len(_PREFIX) :] + "=" * (-len(token[len(_PREFIX) :]) % 4))
        body = json.loads(raw[8:])
    except ValueError:
        bad("damaged")
    if hashlib.sha256(raw[8:]).digest()[:8] != raw[:8]:
        bad("damaged")
    if body["q"] != query.fingerprint() or body["o"] != [o.column.name for o in orders]:
        bad("made for another query")
    if body["a"] != access.binding():
        bad("made for another access")
    return [_bound(o.column, v) for o, v in zip(orders, body["v"], strict=True)]


# plans


def scope_token(scope: str = SCOPE):
    return F.upper(F.sha2(F.col(scope), 256))


def base_plan(df: DataFrame, query: Query, access: Access = Access()) -> DataFrame:
    """Scope, filter and latest per key; neither order nor page."""
    unit = query.unit
    if access.mode == "scoped":
        df = df.where(F.col(SCOPE) == access.scope)
    p = query.normal
    if p != TRUE:
        df = df.where(to_column(p, unit))
    if access.mode == "across":
        df = df.withColumn(SCOPE_TOKEN, scope_token())
    if query.latest:
        partition = [f"`{query.latest.key.name}`"] + ([SCOPE] if access.mode == "across" else [])
        ties = [o.sort() for o in with_tie_break([], unit)]
        rank = RESERVED + "rank"
        newest = W.partitionBy(*partition).orderBy(F.col(f"`{query.latest.timestamp.name}`").desc(), *ties)
        df = df.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) == 1).drop(rank)
    return df


def full_order(query: Query, access: Access = Access()) -> list[Order]:
    orders = list(query.order)
    if access.mode == "across":
        orders.append(Order(Column(SCOPE_TOKEN, Kind.STRING, plain_text=True)))
    return with_tie_break(orders, query.unit)


def _shown(query: Query, access: Access) -> list[str]:
    names = list(query.columns) or query.unit.visible()
    return [f"`{n}`" for n in names] + ([SCOPE] if access.mode == "across" else [])


def plan(df: DataFrame, query: Query, access: Access = Access()) -> DataFrame:
    """The page's rows, lazily, in order. A keyset page may hold one row more than its limit."""
    orders = full_order(query, access)
    out = base_plan(df, query, access)
    page = query.page
    if page.token:
        out = out.where(after(orders, decode_token(page.token, query, orders, access)))
    extra = [o.column.name for o in orders if page.keyset]
    names = list(dict.fromkeys([*_shown(query, access), *(f"`{n}`" for n in extra)]))
    if query.order or page.limit is not None or page.offset:
        out = out.orderBy(*(o.sort() for o in orders))
    if page.offset:
        out = out.offset(page.offset)
    if page.limit is not None:
        out = out.limit(page.limit + 1 if page.keyset else page.limit)
    return out.select(*names)


@dataclass(frozen=True)
class Result:
    rows: list[Row]
    total_count: int | None
    next_token: str | None


def run(df: DataFrame, query: Query, access: Access = Access()) -> Result:
    """A materialised page; without a limit, use plan()."""
    if query.page.limit is None:
        refuse("QN-QUERY-002", "page", "only pages are brought to the driver", "give a limit, or use plan()")
    total = base_plan(df, query, access).count() if query.total_count else None
    rows = plan(df, query, access).collect()  # limit + 1 rows at most
    token = None
    if query.page.keyset and len(rows) > query.page.limit:
        orders, last = full_order(query, access), rows[query.page.limit - 1]
        token = encode_token(query, orders, access, [_constant(o.column, last[o.column.name]) for o in orders])
    names = [n.strip("`") for n in _shown(query, access)]
    return Result([Row(**{n: r[n] for n in names}) for r in rows[: query.page.limit]], total, token)


def _constant(column: Column, v: Any) -> Constant:
    if isinstance(v, dt.datetime) and v.tzinfo is None:
        v = v.replace(tzinfo=dt.timezone.utc)
    if isinstance(v, bytearray):
        v = bytes(v)
    return Constant.of(column, v)


def any_row(df: DataFrame, query: Query, access: Access = Access()) -> bool:
    return not base_plan(df, query, access).isEmpty()


def count(df: DataFrame, query: Query, access: Access = Access()) -> int:
    return base_plan(df, query, access).count()
