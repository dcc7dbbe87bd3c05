"""JSON documents: an id, a canonical body, its schema version, and projected columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import refuse
from quern.functions.identity import canonical_json
from quern.model import Column, Index, Kind, Unit, declare
from quern.operators.fluent import Table
from quern.sources.store import Session

ID, BODY, SCHEMA = "id", "body", "schema_version"


@dataclass(frozen=True)
class Projection:
    """A column that holds what a dotted path of the body holds."""

    column: Column
    path: str

    def of(self, body: Any) -> Any:
        for part in self.path.split("."):
            body = body.get(part) if isinstance(body, dict) else None
        return body


@dataclass(frozen=True)
class DocumentUnit:
    name: str
    projections: tuple[Projection, ...] = ()
    indexes: tuple[Index, ...] = ()
    version: int = 1
    least_version: int = 1
    #: Version to the function that makes its bodies the next version's.
    upcasters: dict[int, Callable[[dict], dict]] = field(default_factory=dict)
    options: dict[str, Any] = field(default_factory=dict)

    def unit(self) -> Unit:
        missing = [v for v in range(self.least_version, self.version) if v not in self.upcasters]
        if missing:
            refuse("QN-DOC-001", self.name, f"no upcaster of versions {missing}")
        own = (Column(ID, Kind.STRING, False), Column(BODY, Kind.JSON, False), Column(SCHEMA, Kind.INT32, False))
        return declare(Unit(self.name, (*own, *(p.column for p in self.projections)), (ID,), self.indexes, **self.options))

    def current(self, body: str | dict, version: int) -> dict:
        """A body in the newest version."""
        if not self.least_version <= version <= self.version:
            refuse("QN-DOC-002", self.name, f"version {version} is outside {self.least_version} to {self.version}")
        out = json.loads(body) if isinstance(body, str) else body
        for v in range(version, self.version):
            out = self.upcasters[v](out)
        return out


class Documents:
    def __init__(self, kind: DocumentUnit, session: Session):
        self.kind, self.session = kind, session

    def _row(self, id: str, body: dict) -> dict[str, Any]:
        return {ID: id, BODY: canonical_json(body), SCHEMA: self.kind.version} | {p.column.name: p.of(body) for p in self.kind.projections}

    def get(self, id: str) -> dict | None:
        row = self.session.read(id=id)
        return None if row is None else self.kind.current(row[BODY], row[SCHEMA])

    def insert(self, id: str, body: dict) -> str:
        return self.session.insert(self._row(id, body))

    def save(self, id: str, body: dict) -> str:
        return self.session.upsert(self._row(id, body))

    def delete(self, id: str) -> str:
        return self.session.delete(id=id)

    def query(self) -> Table:
        return Table(self.session.unit, self.session.df(), self.session.access)

    def upcast(self, df: DataFrame) -> DataFrame:
        """Bodies of a frame in the newest version; rows that are current are not touched by Python."""
        kind = self.kind

        @F.pandas_udf("string")
        def newer(body: pd.Series, version: pd.Series) -> pd.Series:
            return pd.Series([canonical_json(kind.current(b, int(v))) for b, v in zip(body, version, strict=True)])

        old = df.where(F.col(SCHEMA) < kind.version).withColumn(BODY, newer(BODY, SCHEMA)).withColumn(SCHEMA, F.lit(kind.version))
        return df.where(F.col(SCHEMA) >= kind.version).unionByName(old.select(*df.columns))
