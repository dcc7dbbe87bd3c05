"""Typed rows: Python dataclasses as units, with typed writes, reads and projections."""

from __future__ import annotations

import dataclasses
import datetime as dt
import decimal
import types
import typing
import uuid
from typing import Any, Generic, TypeVar

from quern.errors import refuse
from quern.model import Column, Kind, Unit, declare
from quern.operators.fluent import Table
from quern.plans.query import Result
from quern.sources.store import Session, Write

R = TypeVar("R")
_KINDS = {str: Kind.STRING, int: Kind.INT64, decimal.Decimal: Kind.DECIMAL, bool: Kind.BOOLEAN, dt.datetime: Kind.TIMESTAMP, uuid.UUID: Kind.GUID, bytes: Kind.BINARY}


def _kind(hint: Any, name: str) -> tuple[Kind, bool]:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        rest = [a for a in typing.get_args(hint) if a is not type(None)]
        if len(rest) != 1:
            refuse("QN-RECORD-001", name, "a member has one type, or it and None")
        return _kind(rest[0], name)[0], True
    if hint not in _KINDS:
        refuse("QN-RECORD-001", name, f"{hint} is no storage type")
    return _KINDS[hint], False


def unit_of(cls: type, name: str, key: tuple[str, ...], **declaration: Any) -> Unit:
    """A unit from a dataclass's members; a member's metadata are column options (kind=Kind.INT32, max_length=…)."""
    hints = typing.get_type_hints(cls)
    columns = []
    for f in dataclasses.fields(cls):
        kind, nullable = _kind(hints[f.name], f.name)
        columns.append(Column(f.name, f.metadata.get("kind", kind), nullable, **{k: v for k, v in f.metadata.items() if k != "kind"}))
    return declare(Unit(name, tuple(columns), key, **declaration))


class RecordTable(Generic[R]):
    def __init__(self, cls: type[R], session: Session):
        self.cls, self.session = cls, session
        self.names = [f.name for f in dataclasses.fields(cls)]
        missing = {f.name for f in dataclasses.fields(cls)} - set(session.unit.visible())
        if missing:
            refuse("QN-RECORD-002", ",".join(sorted(missing)), "the unit has no such column")

    def _values(self, record: R) -> dict[str, Any]:
        values = {n: getattr(record, n) for n in self.names}
        return {n: str(v) if isinstance(v, uuid.UUID) else v for n, v in values.items()}

    def _record(self, row: Any) -> R:
        hints = typing.get_type_hints(self.cls)
        out = {}
        for n in self.names:
            v = row[n]
            if v is not None and self.session.unit.column(n).kind is Kind.GUID and uuid.UUID in (hints[n], *typing.get_args(hints[n])):
                v = uuid.UUID(v)
            if isinstance(v, dt.datetime) and v.tzinfo is None:
                v = v.replace(tzinfo=dt.timezone.utc)
            out[n] = bytes(v) if isinstance(v, bytearray) else v
        return self.cls(**out)

    def get(self, **key: Any) -> R | None:
        row = self.session.read(**key)
        return None if row is None else self._record(row)

    def insert(self, record: R) -> str:
        return self.session.insert(self._values(record))

    def update(self, record: R, if_version: int | None = None) -> str:
        return self.session.update(self._values(record), if_version)

    def upsert(self, record: R, if_version: int | None = None, create_only: bool = False) -> str:
        return self.session.upsert(self._values(record), if_version, create_only)

    def delete(self, **key: Any) -> str:
        return self.session.delete(**key)

    def staged(self, record: R, mode: str = "upsert") -> Write:
        return Write(mode, self._values(record))

    def query(self) -> Table:
        """Only the record's own columns are read."""
        return Table(self.session.unit, self.session.df(), self.session.access).select(*self.names)

    def records(self, table: Table) -> list[R]:
        result: Result = table.to_list()
        return [self._record(r) for r in result.rows]

    def project(self, cls: type, table: Table) -> list[Any]:
        """A smaller dataclass: its members alone are read."""
        names = [f.name for f in dataclasses.fields(cls)]
        return [cls(**{n: r[n] for n in names}) for r in table.select(*names).to_list().rows]
