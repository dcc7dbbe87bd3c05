"""Declarations: typed columns, keys, layouts, scopes and lifecycles of a unit (a table)."""

from __future__ import annotations

import datetime as dt
import decimal
import enum
import hashlib
import json
import re
import uuid
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from quern.errors import Refusal, Refused, refuse

#: Names with this prefix belong to the engine.
RESERVED = "__quern_"
SCOPE, VERSION, BUCKET = RESERVED + "scope", RESERVED + "version", RESERVED + "bucket"
#: Where a row stands in its files, on frames that carry it.
PLACE = RESERVED + "place"


class Kind(str, enum.Enum):
    STRING = "string"
    INT32 = "int32"
    INT64 = "int64"
    DECIMAL = "decimal"
    BOOLEAN = "boolean"
    TIMESTAMP = "timestamp"
    GUID = "guid"
    BINARY = "binary"
    JSON = "json"
    DOUBLE = "double"


ORDERABLE = {Kind.STRING, Kind.INT32, Kind.INT64, Kind.DECIMAL, Kind.TIMESTAMP, Kind.GUID}
#: The one decimal that predicates take.
EXACT_DECIMAL = (18, 4)


class Collation(str, enum.Enum):
    ORDINAL = "ordinal"
    ASCII_IGNORE_CASE = "ascii-ignore-case"
    UNICODE_IGNORE_CASE = "unicode-ignore-case"


@dataclass(frozen=True)
class Column:
    """A stored column. plain_text declares that a string holds no character beyond U+FFFF, so that
    Spark's own string order is the UTF-16 order and ranges are pushed to the scan."""

    name: str
    kind: Kind
    nullable: bool = True
    max_length: int | None = None
    precision: int = 18
    scale: int = 4
    collation: Collation = Collation.ORDINAL
    default: Any = None
    generated: str | None = None
    plain_text: bool = False

    def spark_type(self) -> T.DataType:
        return {
            Kind.STRING: T.StringType(),
            Kind.INT32: T.IntegerType(),
            Kind.INT64: T.LongType(),
            Kind.DECIMAL: T.DecimalType(self.precision, self.scale),
            Kind.BOOLEAN: T.BooleanType(),
            Kind.TIMESTAMP: T.TimestampType(),
            Kind.GUID: T.StringType(),
            Kind.BINARY: T.BinaryType(),
            Kind.JSON: T.StringType(),
            Kind.DOUBLE: T.DoubleType(),
        }[self.kind]


@dataclass(frozen=True)
class ElementSet:
    """A multi-valued column, usable by element_of alone."""

    name: str
    kind: Kind


@dataclass(frozen=True)
class IndexColumn:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class Index:
    """A declared layout: what the coverage gate admits and, if unique, what writes enforce."""

    name: str
    columns: tuple[IndexColumn, ...]
    unique: bool = False
    excludes_missing: bool = False


@dataclass(frozen=True)
class Derived:
    """A column computed from another when rows are written. algorithm is versioned."""

    name: str
    source: str
    algorithm: str


@dataclass(frozen=True)
class Retention:
    keep_newest: int
    order_column: str
    partition_columns: tuple[str, ...] = ()
    on_append: bool = False


@dataclass(frozen=True)
class Unit:
    name: str
    columns: tuple[Column, ...]
    key: tuple[str, ...]
    indexes: tuple[Index, ...] = ()
    derived: tuple[Derived, ...] = ()
    element_sets: tuple[ElementSet, ...] = ()
    profiles: tuple[Any, ...] = ()
    scoped: bool = False
    versioned: bool = False
    append_window_s: int | None = None
    retention: Retention | None = None
    version: int = 1
    accepts_scans: bool = True

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        for d in self.derived:
            if d.name == name:
                return Column(d.name, Kind.STRING)
        refuse("QN-NAME-001", name, f"{self.name} declares no such column", "declare it")

    def element_set(self, name: str) -> ElementSet:
        for e in self.element_sets:
            if e.name == name:
                return e
        refuse("QN-FLUENT-106", name, "no such element set is declared", "declare the element set")

    def profile(self, name: str):
        for p in self.profiles:
            if p.name == name:
                return p
        refuse("QN-AGG-NAME-001", name, f"{self.name} declares no such profile", "declare it")

    @property
    def sequence(self) -> str | None:
        return next((c.name for c in self.columns if c.generated == "sequence"), None)

    def schema(self) -> T.StructType:
        """Of stored rows, engine columns included."""
        fields = [T.StructField(c.name, c.spark_type(), c.nullable) for c in self.columns]
        fields += [T.StructField(e.name, T.ArrayType(Column(e.name, e.kind).spark_type())) for e in self.element_sets]
        fields += [T.StructField(d.name, T.StringType(), True, {"algorithm": d.algorithm}) for d in self.derived]
        return T.StructType([*fields, T.StructField(SCOPE, T.StringType()), T.StructField(VERSION, T.LongType())])

    def visible(self) -> list[str]:
        return [c.name for c in self.columns] + [e.name for e in self.element_sets]

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(unit_json(self), sort_keys=True).encode()).hexdigest()


def unit_json(unit: Unit) -> dict:
    out = asdict(replace(unit, profiles=()))
    out["profiles"] = [p.name for p in unit.profiles]
    return json.loads(json.dumps(out, default=str))


def unit_from_json(data: dict) -> Unit:
    """Of a declaration file; profiles are declared in code."""
    build = lambda kind, rows: tuple(kind(**r) for r in rows)
    d = dict(data)
    d["columns"] = tuple(Column(**{**c, "kind": Kind(c["kind"]), "collation": Collation(c.get("collation", "ordinal"))}) for c in d["columns"])
    d["key"] = tuple(d["key"])
    d["indexes"] = tuple(Index(**{**i, "columns": build(IndexColumn, i["columns"])}) for i in d.get("indexes", ()))
    d["derived"] = build(Derived, d.get("derived", ()))
    d["element_sets"] = tuple(ElementSet(e["name"], Kind(e["kind"])) for e in d.get("element_sets", ()))
    if r := d.get("retention"):
        d["retention"] = Retention(**{**r, "partition_columns": tuple(r.get("partition_columns", ()))})
    d["profiles"] = ()
    return Unit(**d)


def utf16_units(text: str) -> int:
    return len(text.encode("utf-16-be", "surrogatepass")) // 2


def well_formed(text: str) -> bool:
    return not any(0xD800 <= ord(c) <= 0xDFFF for c in text)


_SCOPE_LIMIT = 128


def check_scope(value: str) -> str:
    """A tenant's partition value."""
    if not value or value != value.strip() or not well_formed(value) or "\0" in value or utf16_units(value) > _SCOPE_LIMIT or value.startswith(RESERVED):
        refuse("QN-SCOPE-001", "scope", "a scope is trimmed, well formed, not reserved and at most 128 UTF-16 units", "choose another value")
    return value


@dataclass(frozen=True)
class Access:
    """Global(), scoped to one tenant, or privileged across all (with an audit record)."""

    mode: str = "global"
    scope: str | None = None
    identity: str | None = None
    purpose: str | None = None

    @staticmethod
    def everything() -> Access:
        return Access()

    @staticmethod
    def to(scope: str) -> Access:
        return Access("scoped", check_scope(scope))

    @staticmethod
    def across(identity: str, purpose: str) -> Access:
        if not identity.strip() or not purpose.strip():
            refuse("QN-SCOPE-002", "audit", "privileged access names who and why", "give an identity and a purpose")
        return Access("across", None, identity, purpose)

    def binding(self) -> str:
        """What continuation tokens are bound to."""
        if self.mode == "across":
            parts = b"".join(len(x.encode()).to_bytes(4, "big") + x.encode() for x in (self.identity, self.purpose))
            return hashlib.sha256(parts).hexdigest()
        return f"{self.mode}:{self.scope or ''}"


@dataclass(frozen=True)
class Constant:
    """A value bound to a column's exact type; no coercion and no rounding."""

    kind: Kind
    value: Any = field(compare=True)

    @staticmethod
    def of(column: Column | ElementSet, value: Any) -> Constant:
        kind, name = column.kind, column.name
        if value is None:
            return Constant(kind, None)

        def wrong(why: str):
            refuse("QN-TYPE-001", name, f"{value!r} {why}", f"give a {kind.value}")

        if kind is Kind.STRING:
            if not isinstance(value, str):
                wrong("is not text")
            if not well_formed(value):
                wrong("is not well-formed UTF-16")
            if getattr(column, "max_length", None) and utf16_units(value) > column.max_length:
                wrong("is longer than the column")
        elif kind in (Kind.INT32, Kind.INT64):
            if isinstance(value, bool) or not isinstance(value, int):
                wrong("is not an integer")
            bits = 31 if kind is Kind.INT32 else 63
            if not -(1 << bits) <= value < 1 << bits:
                wrong("is out of range")
        elif kind is Kind.DECIMAL:
            if not isinstance(value, decimal.Decimal) or not value.is_finite():
                wrong("is not a decimal")
            precision, scale = getattr(column, "precision", 18), getattr(column, "scale", 4)
            digits = value.normalize().as_tuple()
            if -digits.exponent > scale or len(digits.digits) + digits.exponent > precision - scale:
                wrong(f"has more scale or range than decimal({precision},{scale})")
        elif kind is Kind.BOOLEAN:
            if not isinstance(value, bool):
                wrong("is not a boolean")
        elif kind is Kind.TIMESTAMP:
            if not isinstance(value, dt.datetime) or value.tzinfo is None:
                wrong("is not a time with an offset")
            value = value.astimezone(dt.timezone.utc)
        elif kind is Kind.GUID:
            if isinstance(value, str) and re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value):
                value = uuid.UUID(value)
            if not isinstance(value, uuid.UUID):
                wrong("is not a guid")
            value = str(value)
        elif kind is Kind.BINARY:
            if not isinstance(value, (bytes, bytearray)):
                wrong("is not binary")
            value = bytes(value)
        else:
            refuse("QN-SEM-TYPE-001", name, f"{kind.value} takes no part in predicates", "declare an exact column")
        return Constant(kind, value)

    def order_key(self) -> tuple:
        """Null lowest, then the type's order: text by UTF-16 units, guids by their text."""
        if self.value is None:
            return (0,)
        return (1, self.value.encode("utf-16-be") if self.kind is Kind.STRING else self.value)

    def text(self) -> str:
        v = self.value
        if v is None:
            return "null"
        if isinstance(v, bytes):
            v = v.hex()
        elif isinstance(v, dt.datetime):
            v = v.isoformat()
        elif isinstance(v, decimal.Decimal):
            v = format(v.normalize(), "f")
        return f"{self.kind.value}:{json.dumps(v if isinstance(v, (str, bool, int)) else str(v))}"


def validate_unit(unit: Unit) -> list[Refusal]:
    """Portability of a declaration."""
    out: list[Refusal] = []
    add = lambda code, path, why, fix="": out.append(Refusal(code, path, why, fix))
    names = [c.name for c in unit.columns] + [e.name for e in unit.element_sets] + [d.name for d in unit.derived]
    if not unit.name or not unit.columns:
        add("QN-PORT-000", unit.name, "a unit has a name and columns")
    for name in {n for n in names if names.count(n) > 1}:
        add("QN-PORT-001", name, "is declared twice")
    for name in names:
        if name.lower().startswith(RESERVED) or not name:
            add("QN-PORT-002", name, "is reserved", "rename it")
    own = {c.name: c for c in unit.columns}
    if not unit.key:
        add("QN-PORT-003", "key", "a unit has a key")
    for k in unit.key:
        if k not in own:
            add("QN-PORT-003", k, "the key names no column")
        elif own[k].nullable or own[k].kind not in ORDERABLE | {Kind.BOOLEAN}:
            add("QN-PORT-003", k, "key columns are not null and orderable")
    for c in unit.columns:
        if c.kind is Kind.STRING and c.max_length is not None and c.max_length <= 0:
            add("QN-PORT-004", c.name, "lengths are positive")
        if c.kind is Kind.DECIMAL and not 0 <= c.scale <= c.precision <= 38:
            add("QN-PORT-005", c.name, "decimals have at most 38 digits")
        if c.kind is Kind.DOUBLE:
            add("QN-PORT-006", c.name, "binary floating point is not stored", "declare a decimal")
        if c.generated == "sequence" and (unit.key != (c.name,) or c.kind is not Kind.INT64):
            add("QN-PORT-008", c.name, "a sequence is the only key column, of int64")
        if c.default is not None:
            try:
                Constant.of(c, c.default)
            except Refused as e:
                add("QN-PORT-009", c.name, str(e))
    for i in unit.indexes:
        for c in i.columns:
            if c.name not in own and c.name not in {d.name for d in unit.derived}:
                add("QN-PORT-010", i.name, f"{c.name} is no column")
            elif c.name in own and own[c.name].kind not in ORDERABLE | {Kind.BOOLEAN}:
                add("QN-PORT-010", i.name, f"{c.name} is not orderable")
    for d in unit.derived:
        if d.source not in own or own[d.source].kind is not Kind.STRING:
            add("QN-PORT-011", d.name, "derives from no string column")
    if r := unit.retention:
        if r.keep_newest < 0 or r.order_column not in own or own[r.order_column].nullable or own[r.order_column].kind not in ORDERABLE or any(p not in own for p in r.partition_columns):
            add("QN-PORT-007", "retention", "keeps a number of rows that is not negative, ordered by a column that is not null, of declared partitions")
    return out


def declare(unit: Unit) -> Unit:
    """The unit, if it is portable."""
    if found := validate_unit(unit):
        raise Refused(*found)
    return unit
