"""Transactional units on plain Parquet: immutable data folders, numbered manifests, one winner a number.

A unit's rows lie in key buckets. A change reads and rewrites only the buckets that hold a changed
key; what it wrote becomes visible by creating the next manifest, which fails if another writer has
created it, and then the change is made again on the new state. Sequences, high-water marks and
operation ledgers live in the manifest, so they commit with the rows.

A unit of work over several units creates the next manifest of each, all naming one decision file;
they count once that file says so. It is created once, by the unit of work or by a writer that
found such a manifest undecided and gave up waiting, so either all count or none.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import Refusal, Refused, refuse
from quern.functions.text_keys import key_column
from quern.model import BUCKET, RESERVED, SCOPE, VERSION, Access, Constant, Unit, declare, unit_from_json, unit_json
from quern.operators import aggregate
from quern.plans import query as plans
from quern.plans.compile import order_key
from quern.plans.coverage import Gate, fence
from quern.sources.files import Files, conform

OP, ORDINAL, EXPECT, SET_, OUTCOME = (RESERVED + x for x in ("op", "ordinal", "expect", "set_", "outcome"))
RETRIES, RECLAIM = 8, 128
#: Seconds that a writer waits for the decision on a manifest of several units before it decides against it.
PATIENCE_S = 5.0
DONE, UNDONE = "committed", "abandoned"


class Conflict(RuntimeError):
    """Other writers won every attempt."""


class BatchError(RuntimeError):
    """Staged writes failed; nothing was committed."""

    def __init__(self, outcomes: list[Row]):
        self.outcomes = outcomes
        super().__init__(f"{len(outcomes)} failed writes")


@dataclass
class Manifest:
    number: int = 0
    unit: dict = field(default_factory=dict)
    #: Bucket to data folders.
    data: dict[str, list[str]] = field(default_factory=dict)
    sequence: int = 0
    #: Scope to the highest committed sequence; it survives deletes.
    high_water: dict[str, int] = field(default_factory=dict)
    ledger: dict[str, dict] = field(default_factory=dict)
    history: list[str] = field(default_factory=list)
    #: The decision file of a unit of work over several units.
    decision: str | None = None

    def copy(self) -> Manifest:
        return replace(self, data=dict(self.data), ledger=dict(self.ledger), high_water=dict(self.high_water), history=list(self.history), decision=None)

    def text(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)


@dataclass(frozen=True)
class Write:
    """One staged row."""

    mode: str  # insert, update, upsert, delete, compare-and-delete
    values: Mapping[str, Any]
    if_version: int | None = None
    create_only: bool = False
    expected: Mapping[str, Any] | None = None
    #: Name of the unit; the unit of work's first where none is given.
    unit: str | None = None


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = 16, clock: Callable[[], float] = time.time, audit: Callable[[dict], None] | None = None):
        self.spark, self.root, self.buckets, self.clock, self.audit = spark, root.rstrip("/"), buckets, clock, audit
        self.files = Files(spark)
        self.commands: Counter[str] = Counter()

    def _folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _decided(self, path: str, settle: bool) -> bool:
        """Whether the manifests that name this decision count. With settle an open one is waited for, then decided against."""
        began = time.monotonic()
        while True:
            told = self.files.read(path) if self.files.exists(path) else ""
            if told or not settle:
                return told == DONE
            waited = time.monotonic() - began
            if waited > 2 * PATIENCE_S:  # created, never written
                raise Conflict(path)
            if waited < PATIENCE_S or not self.files.create(path, UNDONE):
                time.sleep(0.05)

    def _last(self, name: str, settle: bool = False) -> Manifest | None:
        """The newest state that counts; its number is that of the newest manifest, so the next one is free. Writers settle."""
        names = [n for n in self.files.names(self._folder(name) + "/manifest") if n.endswith(".json")]
        for n in reversed(names):
            found = Manifest(**json.loads(self.files.read(f"{self._folder(name)}/manifest/{n}")))
            if found.decision is None or self._decided(found.decision, settle):
                found.number = int(names[-1].removesuffix(".json"))
                return found
        return None

    def manifest(self, unit: Unit, settle: bool = False) -> Manifest:
        found = self._last(unit.name, settle)
        if found is None:
            refuse("QN-RUNTIME-003", unit.name, "the unit does not exist", "create it")
        return found

    def publish(self, name: str, manifest: Manifest) -> bool:
        return self.files.create(f"{self._folder(name)}/manifest/{manifest.number:012d}.json", manifest.text())

    def create(self, unit: Unit) -> Unit:
        declare(unit)
        for p in unit.profiles:
            aggregate.validate_profile(p, unit)
        if self._last(unit.name) is None:
            self.publish(unit.name, Manifest(1, unit_json(unit), history=[unit.fingerprint()]))
        return unit

    def commit(self, unit: Unit, change: Callable[[Manifest], tuple[Manifest | None, Any]]) -> Any:
        """Make a change on the newest state, again if another writer was first."""
        for _ in range(RETRIES):
            now = self.manifest(unit, settle=True)
            new, out = change(now.copy())
            if new is None:
                return out
            new.number = now.number + 1
            if self.publish(unit.name, new):
                return out
            self.commands["conflicts"] += 1
        raise Conflict(unit.name)

    # reading

    def indexes(self, name: str):
        """The layouts that the deployed unit declares."""
        found = self._last(name)
        return unit_from_json(found.unit).indexes if found else ()

    def rows(self, unit: Unit, manifest: Manifest | None = None, only: Iterable[str] | None = None) -> DataFrame:
        manifest = manifest or self.manifest(unit)
        paths = [p for b, ps in manifest.data.items() if only is None or b in only for p in ps]
        schema = unit.schema()
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*paths)
        fill = {c.name: c.default for c in unit.columns if c.default is not None}  # of files written before the column
        return df.withColumns({n: F.coalesce(F.col(f"`{n}`"), F.lit(v).cast(unit.column(n).spark_type())) for n, v in fill.items() if not unit.column(n).nullable}) if fill else df

    def admit(self, unit: Unit) -> list[Refusal]:
        """Deployed against declared: changed columns stop the unit, changed layouts only what needs them."""
        deployed = unit_from_json(self.manifest(unit).unit)
        have = {c.name: c for c in deployed.columns}
        drift = [Refusal("QN-RUNTIME-001", c.name, "missing or changed in the deployed unit") for c in unit.columns if c.name not in have or (have[c.name].kind, have[c.name].collation) != (c.kind, c.collation)]
        drift += [Refusal("QN-RUNTIME-001", d.name, "the stored key has another algorithm") for d in unit.derived if d not in deployed.derived]
        if drift:
            raise Refused(*drift)
        return [Refusal("QN-RUNTIME-002", i.name, "the layout is not deployed as declared") for i in unit.indexes if i not in deployed.indexes]

    def inspect_files(self, unit: Unit) -> list[Refusal]:
        """Columns whose files hold another type than declared, or that no file of a bucket holds."""
        manifest, fields = self.manifest(unit), {f.name: f.dataType for f in unit.schema()}
        found: dict[str, Refusal] = {}
        for b, paths in manifest.data.items():
            for path in paths:
                have = {f.name: f.dataType for f in self.spark.read.parquet(path).schema}
                for name, kind in fields.items():
                    if name not in have:
                        if not any(c.name == name and c.default is not None for c in unit.columns):
                            found.setdefault(name, Refusal("QN-RUNTIME-004", name, f"no column of that name in bucket {b}"))
                    elif have[name] != kind:
                        found.setdefault(name, Refusal("QN-RUNTIME-004", name, f"{have[name].simpleString()} in bucket {b}, declared {kind.simpleString()}"))
        return list(found.values())

    def vacuum(self, older_than_s: float = 86_400.0) -> int:
        """Delete data and work folders that no newest manifest names and that are older than that: readers of older states and writers at work need them. Returns their number."""
        removed = 0
        for name in self.files.names(self.root):
            last = self._last(name)
            if last is None:
                continue
            named = {p.rsplit("/", 1)[0] for ps in last.data.values() for p in ps}
            for kind in ("data", "work"):
                for folder in self.files.names(f"{self._folder(name)}/{kind}"):
                    path = f"{self._folder(name)}/{kind}/{folder}"
                    if path not in named and self.files.age(path) > older_than_s:
                        self.files.delete(path)
                        removed += 1
        return removed

    def session(self, unit: Unit, access: Access = Access(), gate: Gate | None = None) -> Session:
        if unit.scoped == (access.mode == "global"):
            refuse("QN-SCOPE-003", unit.name, "scoped units are opened with a scope, others without", "change the access")
        self.admit(unit)
        return Session(self, unit, access, gate)

    def publish_all(self, changed: Sequence[tuple[str, Manifest]]) -> bool:
        """Publish the next manifests of several units, all or none."""
        if len(changed) == 1:
            return self.publish(*changed[0])
        path = f"{self.root}/_decisions/{uuid.uuid4().hex}"
        for name, m in changed:
            m.decision = path
            if not self.publish(name, m):
                self.files.create(path, UNDONE)
                return False
        return self.files.create(path, DONE)

    def unit_of_work(self, unit: Unit | Sequence[Unit], access: Access | Mapping[str, Access] = Access(), max_rows: int = 1000, exact: bool = False) -> UnitOfWork:
        """Of one unit or of several; access is one for all or by the unit's name."""
        units = [unit] if isinstance(unit, Unit) else list(unit)
        return UnitOfWork([self.session(u, access if isinstance(access, Access) else access.get(u.name, Access())) for u in units], max_rows, exact)


class Session:
    """Reads and writes of one unit under one access."""

    def __init__(self, store: Store, unit: Unit, access: Access, gate: Gate | None):
        self.store, self.unit, self.access, self.gate, self.spark = store, unit, access, gate, store.spark

    # reading

    def _plain(self) -> None:
        if self.access.mode == "across":
            refuse("QN-SCOPE-004", self.unit.name, "privileged access only queries across scopes", "open a scoped session")

    def df(self, manifest: Manifest | None = None) -> DataFrame:
        rows = self.store.rows(self.unit, manifest)
        return rows.where(F.col(SCOPE) == self.access.scope) if self.access.mode == "scoped" else rows

    def read(self, **key: Any) -> Row | None:
        """A row by its key: its bucket alone is read."""
        return self._read(key)

    def _read(self, key: Mapping[str, Any], manifest: Manifest | None = None) -> Row | None:
        self._plain()
        if set(key) != set(self.unit.key):
            refuse("QN-KEY-003", self.unit.name, "a point read gives the whole key")
        for k, v in key.items():
            Constant.of(self.unit.column(k), v)
        frame = self._frame([key], list(self.unit.key))
        bucket = frame.select(self._bucket()).first()[0]
        found = self.store.rows(self.unit, manifest, [str(bucket)])
        if self.access.mode == "scoped":
            found = found.where(F.col(SCOPE) == self.access.scope)
        for k, v in key.items():
            found = found.where(F.col(f"`{k}`") == F.lit(v))
        rows = found.select(*(f"`{c}`" for c in self.unit.visible()), VERSION).limit(1).collect()
        return rows[0] if rows else None

    def _admit(self, q: plans.Query) -> None:
        if self.gate is not None:
            self.gate.admit(q)
        fence(q, self.access)

    def query(self, q: plans.Query) -> plans.Result:
        self._plain()
        self._admit(q)
        return plans.run(self.df(), q, self.access)

    def query_across(self, q: plans.Query) -> plans.Result:
        if self.access.mode != "across":
            refuse("QN-SCOPE-005", self.unit.name, "querying across scopes is privileged", "open a privileged session")
        self._admit(q)
        if self.store.audit:
            self.store.audit({"unit": self.unit.name, "identity": self.access.identity, "purpose": self.access.purpose, "query": q.fingerprint()})
        return plans.run(self.df(), q, self.access)

    def aggregate(self, q: aggregate.AggregateQuery) -> aggregate.AggregateResult:
        self._plain()
        return aggregate.run(self.df(), self.unit, self.unit.profile(q.profile), q, self.access)

    # frames of changes

    def _bucket(self):
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.unit.key)), F.lit(self.store.buckets)).cast("int").alias(BUCKET)

    def _frame(self, rows: Sequence[Mapping[str, Any]], names: Sequence[str]) -> DataFrame:
        fields = {f.name: f for f in self.unit.schema()}
        schema = T.StructType([T.StructField(n, fields[n].dataType) for n in names])
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)

    def _check(self, values: Mapping[str, Any], whole: bool) -> None:
        names = set(self.unit.visible())
        for n, v in values.items():
            if n not in names:
                self.unit.column(n)
            if n in {e.name for e in self.unit.element_sets}:
                continue
            c = self.unit.column(n)
            if v is None and not c.nullable:
                refuse("QN-WRITE-001", n, "is not null")
            if c.kind.value not in ("json", "double"):
                Constant.of(c, v)
        missing = [k for k in self.unit.key if values.get(k) is None and not self.unit.column(k).generated]
        if whole:
            missing += [c.name for c in self.unit.columns if not c.nullable and c.default is None and c.generated is None and values.get(c.name) is None and c.name not in self.unit.key]
        if missing:
            refuse("QN-WRITE-001", ",".join(missing), "is not null")

    # the one change that all writes are

    def _merged(self, current: DataFrame, changes: DataFrame, names: Sequence[str]) -> DataFrame:
        """current and changes (one row a key) outer-joined: OUTCOME where a change was, and the row that results (or none)."""
        keys = [*self.unit.key, SCOPE]
        new = changes.select(*(F.col(f"`{c}`").alias("n_" + c) for c in changes.columns))
        on = reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.col(f"`n_{k}`")) for k in keys])
        both = current.withColumn("here", F.lit(True)).join(new, on, "full_outer")
        here, op = F.coalesce("here", F.lit(False)), F.col("n_" + OP)
        version = F.col("n_" + EXPECT)
        differs = version.isNotNull() & ~F.col(VERSION).eqNullSafe(version)
        expected = [c[len(SET_) :] for c in changes.columns if c.startswith(SET_)]
        same = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"`n_{SET_}{c}`")) for c in expected], F.lit(True))
        outcome = (
            F.when(op.isNull(), F.lit(None).cast("string"))
            .when(op == "insert", F.when(here, "UniqueViolation").otherwise("Inserted"))
            .when(op == "create", F.when(here, "VersionConflict").otherwise("Inserted"))
            .when(~here, F.when((op == "upsert") & version.isNull(), "Inserted").otherwise("NotFound"))
            .when(differs, "VersionConflict")
            .when(op == "delete", "Deleted")
            .when(op == "compare-and-delete", F.when(same, "Deleted").otherwise("ComparisonMismatch"))
            .otherwise("Updated")
        )
        both = both.withColumn(OUTCOME, outcome)
        out = F.col(OUTCOME)
        fields = {f.name: f for f in self.unit.schema()}
        derived = {d.name for d in self.unit.derived}
        columns = []
        for n, f in fields.items():
            if n in derived:
                continue
            old = F.col(f"`{n}`")
            if n == VERSION:
                value = F.when(out == "Updated", old + 1).when(out == "Inserted", F.lit(1).cast("long")).otherwise(old)
            elif n in keys:
                value = F.coalesce(old, F.col(f"`n_{n}`"))
            else:
                default = next((c.default for c in self.unit.columns if c.name == n), None)
                fresh = F.col(f"`n_{n}`") if n in names else F.lit(default).cast(f.dataType)
                given = F.col(f"`n_{n}`") if n in names else old
                value = F.when(out == "Updated", given).when(out == "Inserted", fresh).otherwise(old)
            columns.append(value.alias(n))
        gone = out.isin("Deleted", "NotFound", "VersionConflict", "UniqueViolation", "ComparisonMismatch") & (~here | (out == "Deleted"))
        row = both.select(*columns, F.coalesce(gone, F.lit(False)).alias("__gone"), OUTCOME, F.col("n_" + ORDINAL).alias(ORDINAL))
        for d in self.unit.derived:
            row = row.withColumn(d.name, key_column(F.col(f"`{d.source}`"), d.algorithm))
        return row

    def _write(self, rows: DataFrame, manifest: Manifest, touched: Sequence[str]) -> None:
        """New folders for the touched buckets."""
        path = f"{self.store._folder(self.unit.name)}/data/{uuid.uuid4().hex}"
        schema = [f.name for f in self.unit.schema()]
        rows.select(*(f"`{n}`" for n in schema), self._bucket()).repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(path)
        names = set(self.store.files.names(path))
        for b in touched:
            manifest.data.pop(b, None)
            if f"{BUCKET}={b}" in names:
                manifest.data[b] = [f"{path}/{BUCKET}={b}"]

    def _unique(self, before: DataFrame) -> None:
        """Unique layouts over the whole resulting unit."""
        for i in self.unit.indexes:
            if i.unique:
                cols = [f"`{c.name}`" for c in i.columns]
                df = before
                if i.excludes_missing:
                    df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))
                if not df.groupBy(SCOPE, *cols).count().where("count > 1").isEmpty():
                    refuse("QN-WRITE-002", i.name, "another row has these values")

    def _merge(self, manifest: Manifest, groups: Sequence[tuple[DataFrame, Sequence[str]]], strict: bool = False) -> tuple[bool, DataFrame]:
        """Merge groups of changes (disjoint keys) into a manifest at hand. Whether it changed, and (ORDINAL, OUTCOME) rows as a stored frame."""
        touched = sorted({str(r[0]) for frame, _ in groups for r in frame.select(self._bucket()).distinct().collect()})  # at most the bucket count
        current = self.store.rows(self.unit, manifest, touched)
        outcomes = None
        for frame, names in groups:
            merged = self._merged(current, frame, names)
            path = f"{self.store._folder(self.unit.name)}/work/{uuid.uuid4().hex}"
            merged.write.parquet(path)
            merged = self.spark.read.schema(merged.schema).parquet(path)
            part = merged.where(F.col(OUTCOME).isNotNull()).select(ORDINAL, OUTCOME)
            outcomes = part if outcomes is None else outcomes.unionAll(part)
            current = merged.where("not __gone").drop("__gone", OUTCOME, ORDINAL)
        self.store.commands["batches"] += len(groups)
        failed = outcomes.where(F.col(OUTCOME).isin("UniqueViolation", "NotFound", "VersionConflict", "ComparisonMismatch"))
        if strict and (rows := failed.collect()):  # of writes that the caller staged
            raise BatchError(rows)
        if outcomes.where(F.col(OUTCOME).isin("Inserted", "Updated", "Deleted")).isEmpty():
            return False, outcomes
        if any(i.unique for i in self.unit.indexes):
            rest = self.store.rows(self.unit, manifest, [b for b in manifest.data if b not in touched])
            self._unique(current.select(*(f"`{f.name}`" for f in self.unit.schema())).unionAll(rest))
        self._write(current, manifest, touched)
        return True, outcomes

    def _apply(self, groups: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
        """Merge groups of changes in one commit."""

        def change(manifest: Manifest):
            changed, outcomes = self._merge(manifest, groups)
            return manifest if changed else None, outcomes

        return self.store.commit(self.unit, change)

    def _changes(self, rows: Sequence[Mapping[str, Any]] | DataFrame, mode: str, if_version: int | None = None, expected: Mapping[str, Any] | None = None) -> tuple[DataFrame, list[str]]:
        if isinstance(rows, DataFrame):
            names = [c for c in rows.columns if c in self.unit.visible()]
            frame = rows.select(*(F.col(f"`{n}`").cast(self.unit.schema()[n].dataType).alias(n) for n in names), (F.col(ORDINAL) if ORDINAL in rows.columns else F.monotonically_increasing_id()).alias(ORDINAL))
        else:
            for r in rows:
                self._check(r, mode in ("insert", "create"))
            names = list(dict.fromkeys(n for r in rows for n in r))
            frame = self._frame(rows, names).coalesce(1).withColumn(ORDINAL, F.monotonically_increasing_id())
        frame = frame.withColumns({SCOPE: F.lit(self.access.scope).cast("string"), OP: F.lit(mode), EXPECT: F.lit(if_version).cast("long")})
        for n, v in (expected or {}).items():
            Constant.of(self.unit.column(n), v)
            frame = frame.withColumn(SET_ + n, F.lit(v).cast(self.unit.column(n).spark_type()))
        return frame, names

    def _one(self, values: Mapping[str, Any], mode: str, **how: Any) -> str:
        self._plain()
        return self._apply([self._changes([values], mode, **how)]).first()[OUTCOME]

    def insert(self, values: Mapping[str, Any]) -> str:
        if self.unit.sequence and values.get(self.unit.sequence) is None:
            return self.append_rows([values])[0]
        return self._one(values, "insert")

    def insert_all(self, rows: DataFrame) -> DataFrame:
        """Outcomes of many inserts, one commit."""
        self._plain()
        return self._apply([self._changes(rows, "insert")])

    def update(self, values: Mapping[str, Any], if_version: int | None = None) -> str:
        return self._one(values, "update", if_version=self._version(if_version))

    def upsert(self, values: Mapping[str, Any], if_version: int | None = None, create_only: bool = False) -> str:
        if create_only and if_version is not None:
            refuse("QN-WRITE-003", self.unit.name, "create-only and a version exclude each other")
        if self.unit.sequence:
            return self._one(values, "update", if_version=self._version(if_version))
        return self._one(values, "create" if create_only else "upsert", if_version=self._version(if_version))

    def upsert_all(self, rows: DataFrame) -> DataFrame:
        self._plain()
        return self._apply([self._changes(rows, "upsert")])

    def delete(self, if_version: int | None = None, **key: Any) -> str:
        return self._one(key, "delete", if_version=self._version(if_version))

    def delete_all(self, keys: DataFrame) -> DataFrame:
        self._plain()
        return self._apply([self._changes(keys, "delete")])

    def compare_and_delete(self, expected: Mapping[str, Any], **key: Any) -> str:
        for n in expected:
            if self.unit.column(n).kind.value in ("json", "double"):
                refuse("QN-WRITE-004", n, "is not compared exactly")
        return self._one(key, "compare-and-delete", expected=expected)

    def _version(self, v: int | None) -> int | None:
        if v is not None and not self.unit.versioned:
            refuse("QN-WRITE-005", self.unit.name, "the unit keeps no versions", "declare it versioned")
        return v

    # appends, sequences, retention

    def append_rows(self, rows: Sequence[Mapping[str, Any]] | DataFrame, operation: str | None = None, exact: bool = False) -> list[str]:
        """Insert new rows, all or none. With an operation id, once within the unit's window: later calls replay."""
        self._plain()
        if operation is not None:
            if self.unit.append_window_s is None:
                refuse("QN-APPEND-003", self.unit.name, "the unit keeps no operations", "declare an append window")
            if not operation or len(operation) > 256:
                refuse("QN-APPEND-004", "operation", "an operation id has 1 to 256 characters")
        if not isinstance(rows, DataFrame) and not rows:
            refuse("QN-APPEND-005", "rows", "an append has rows")
        key = f"{self.access.scope or ''}|{operation}"
        if isinstance(rows, DataFrame):
            # rows in any order: their number, and the sum of two digests of each
            of = [F.col(f"`{n}`").cast("string") for n in sorted(rows.columns)]
            summed = [F.sum(F.xxhash64(F.lit(i), *(F.coalesce(F.concat(F.lit("v"), x), F.lit("n")) for x in of)).cast("decimal(38,0)")) for i in (0, 1)]
            print_ = "|".join(map(str, [*sorted(rows.columns), *rows.agg(F.count(F.lit(1)), *summed).first()])) if operation is not None else ""
        else:
            parts = [json.dumps({n: (Constant.of(self.unit.column(n), v).text() if self.unit.column(n).kind.value not in ("json", "double") else repr(v)) for n, v in sorted(r.items())}, sort_keys=True) for r in rows]
            print_ = hashlib.sha256("\n".join(f"{len(p)}:{p}" for p in parts).encode()).hexdigest()
        seq = self.unit.sequence
        base: dict[str, int] = {}

        def admit(manifest: Manifest):
            now = self.store.clock()
            if operation is not None:
                entry = manifest.ledger.get(key)
                if entry and now - entry["at"] <= self.unit.append_window_s:
                    if exact and entry.get("outcomes") is None:
                        refuse("QN-APPEND-002", operation, "the first call kept no exact outcomes")
                    if exact and entry["print"] != print_:
                        refuse("QN-APPEND-001", operation, "the operation was used with other rows")
                    return ["Replayed"] if not exact else entry["outcomes"]
                old = sorted((k for k, e in manifest.ledger.items() if now - e["at"] > self.unit.append_window_s), key=lambda k: manifest.ledger[k]["at"])
                for k in old[:RECLAIM]:
                    del manifest.ledger[k]
            base["at"] = now
            return None

        def change(manifest: Manifest):
            if (known := admit(manifest)) is not None:
                return None, known
            frame, names = self._changes(rows, "insert")
            if seq:
                names = [n for n in names if n != seq] + [seq]
                # numbers by place: counts of each partition, then a running number inside
                path = f"{self.store._folder(self.unit.name)}/work/{uuid.uuid4().hex}"
                frame.drop(seq).withColumn("p", F.spark_partition_id()).write.parquet(path)
                held = self.spark.read.parquet(path)
                counts = sorted((r["p"], r["count"]) for r in held.groupBy("p").count().collect())  # a row for each partition
                starts, total = [], manifest.sequence
                for p, n in counts:
                    starts.append((p, total))
                    total += n
                offset = F.broadcast(self.spark.createDataFrame(starts, "p int, start long"))
                frame = held.join(offset, "p").withColumn(seq, F.col("start") + F.row_number().over(W.partitionBy("p").orderBy(ORDINAL))).drop("p", "start")
                manifest.sequence = total
                scope = self.access.scope or ""
                manifest.high_water[scope] = max(manifest.high_water.get(scope, 0), total)
            touched = sorted({str(r[0]) for r in frame.select(self._bucket()).distinct().collect()})
            keys = [f"`{k}`" for k in self.unit.key]
            if not seq:
                if not frame.groupBy(*keys).count().where("count > 1").isEmpty():
                    refuse("QN-APPEND-006", self.unit.name, "a key occurs twice in the rows")
                taken = self.store.rows(self.unit, manifest, touched).where(F.col(SCOPE).eqNullSafe(F.lit(self.access.scope)))
                if not taken.select(*keys).join(frame.select(*keys), list(self.unit.key), "left_semi").isEmpty():
                    raise BatchError([])
            full = conform(frame.select(*(f"`{n}`" for n in names), SCOPE), self.unit, self.access.scope)
            for d in self.unit.derived:
                full = full.withColumn(d.name, key_column(F.col(f"`{d.source}`"), d.algorithm))
            if any(i.unique for i in self.unit.indexes):
                self._unique(full.select(*(f"`{f.name}`" for f in self.unit.schema())).unionAll(self.store.rows(self.unit, manifest)))
            path = f"{self.store._folder(self.unit.name)}/data/{uuid.uuid4().hex}"
            full.select(*(f"`{f.name}`" for f in self.unit.schema()), self._bucket()).write.partitionBy(BUCKET).parquet(path)
            for n in self.store.files.names(path):
                if n.startswith(BUCKET):
                    manifest.data.setdefault(n.split("=")[1], []).append(f"{path}/{n}")
            outcomes = None
            if exact:
                outcomes = [json.dumps({seq: r[0]} if seq else {}) for r in frame.orderBy(ORDINAL).select(seq if seq else ORDINAL).collect()]  # of rows that the caller gave
            if operation is not None:
                manifest.ledger[key] = {"at": base["at"], "print": print_, "outcomes": outcomes}
            self.store.commands["appends"] += 1
            return manifest, outcomes or ["Inserted"]

        out = self.store.commit(self.unit, change)
        if self.unit.retention and self.unit.retention.on_append:
            self.apply_retention()
        return out

    def append(self, operation: str, rows: Sequence[Mapping[str, Any]] | DataFrame) -> str:
        return "Replayed" if self.append_rows(rows, operation) == ["Replayed"] else "Inserted"

    def append_with_outcomes(self, operation: str, rows: Sequence[Mapping[str, Any]]) -> list[dict]:
        return [json.loads(x) for x in self.append_rows(rows, operation, exact=True)]

    def apply_retention(self, keep: int | None = None, max_rows_per_batch: int = 512, operation: str | None = None, stop: Callable[[], bool] | None = None) -> dict:
        """Keep the newest rows of each partition. With an operation id the pass runs once.

        Without one, buckets are committed in batches of about max_rows_per_batch deleted rows, a bucket
        at least; stop is asked before each batch, and a pass that was stopped is resumed by the next call.
        The rows to delete are found once, and a batch deletes what of them is still there.
        """
        self._plain()
        r = self.unit.retention
        if r is None:
            refuse("QN-RETAIN-001", self.unit.name, "the unit keeps everything", "declare retention")
        n = r.keep_newest if keep is None else keep
        if n < 0:
            refuse("QN-RETAIN-002", "keep", "is not negative")
        key = f"{self.access.scope or ''}|retention|{operation}"
        print_ = f"{n}|{r.order_column}|{','.join(r.partition_columns)}"
        mine = F.lit(True) if self.access.scope is None else F.col(SCOPE) == self.access.scope

        def surplus(manifest: Manifest) -> tuple[DataFrame | None, dict[str, int]]:
            """Keys of the rows beyond the newest n, by bucket, and their number in each."""
            rank = F.row_number().over(retention_window(self.unit))
            path = f"{self.store._folder(self.unit.name)}/work/{uuid.uuid4().hex}"
            keys = self.store.rows(self.unit, manifest).where(mine).withColumn("__rank", rank).where(F.col("__rank") > n).select(SCOPE, *(f"`{k}`" for k in self.unit.key), self._bucket())
            keys.write.parquet(path)
            held = self.spark.read.schema(keys.schema).parquet(path)
            return held, {str(x[0]): x[1] for x in held.groupBy(BUCKET).count().collect()}  # a row for each bucket

        def rewrite(manifest: Manifest, gone: DataFrame, buckets: Sequence[str]) -> None:
            gone = gone.where(F.col(BUCKET).isin([int(b) for b in buckets]))
            rows = self.store.rows(self.unit, manifest, buckets)
            on = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(gone[k]) for k in (SCOPE, *self.unit.key)])
            self._write(rows.join(gone, on, "left_anti"), manifest, buckets)

        if operation:

            def once(manifest: Manifest):
                if entry := manifest.ledger.get(key):
                    if entry["print"] != print_:
                        refuse("QN-APPEND-001", operation, "the operation was used with another watermark")
                    return None, entry["outcomes"]
                gone, counts = surplus(manifest)
                out = {"deleted": sum(counts.values()), "batches": int(bool(counts)), "stopped": False}
                manifest.ledger[key] = {"at": self.store.clock(), "print": print_, "outcomes": out}
                if counts:
                    rewrite(manifest, gone, sorted(counts))
                return manifest, out

            return self.store.commit(self.unit, once)

        gone, counts = surplus(self.store.manifest(self.unit))
        out = {"deleted": 0, "batches": 0, "stopped": False}
        waiting = sorted(counts)
        while waiting:
            if stop is not None and stop():
                return out | {"stopped": True}
            batch, rows = [], 0
            while waiting and (not batch or rows + counts[waiting[0]] <= max_rows_per_batch or stop is None):
                rows += counts[waiting[0]]
                batch.append(waiting.pop(0))

            def some(manifest: Manifest, batch=batch):
                rewrite(manifest, gone, batch)
                return manifest, None

            self.store.commit(self.unit, some)
            out["deleted"] += rows
            out["batches"] += 1
        return out

    def inspect(self) -> dict:
        """What the unit has committed, ever: the high-water mark does not go back. None: nothing yet."""
        m = self.store.manifest(self.unit)
        return {"commit": m.number, "high_water": m.high_water.get(self.access.scope or ""), "operations": len(m.ledger)}


def retention_window(unit: Unit) -> W:
    r = unit.retention
    keys = [order_key(unit.column(k)).asc() for k in unit.key]
    return W.partitionBy(SCOPE, *(f"`{p}`" for p in r.partition_columns)).orderBy(order_key(unit.column(r.order_column)).desc(), *keys)


class UnitOfWork:
    """Staged writes of one or more units: the last for a key wins; they commit together or not at all.

    At max_rows staged writes, before a query and at the commit they are flushed: coalesced, grouped by
    unit, mode and columns, and merged into states that nobody else sees. Changes that were flushed lie
    in files, so the driver holds max_rows of them at most, and are merged again where another writer
    was first. Superseded means by a later write of the same flush. With exact, an outcome is kept for
    every write. After a failure nothing is committed and only another unit of work can go on.
    """

    def __init__(self, sessions: Session | Sequence[Session], max_rows: int, exact: bool):
        if max_rows < 1:
            refuse("QN-BATCH-003", "max_rows", "is at least one")
        listed = [sessions] if isinstance(sessions, Session) else list(sessions)
        self.sessions = {s.unit.name: s for s in listed}
        if not listed or len(self.sessions) < len(listed):
            refuse("QN-BATCH-004", "units", "a unit of work has different units, one at least")
        for s in listed:
            s._plain()
        self.store, self.first, self.max_rows, self.exact = listed[0].store, listed[0].unit.name, max_rows, exact
        self.staged: list[tuple[int, Write]] = []
        self.failed = False
        self._begin()

    def _begin(self) -> None:
        self.total = 0
        self.flushed: list[tuple[str, list[tuple[str, T.StructType, list[str]]]]] = []
        self.superseded: dict[int, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[str, Manifest] = {}
        self.changed: set[str] = set()
        self.counts: Counter[str] = Counter()
        self.outcomes: dict[int, str] = {}

    def _session(self, write: Write) -> Session:
        name = write.unit or self.first
        if name not in self.sessions:
            refuse("QN-BATCH-005", name, "the unit is not of this unit of work", "begin one that has it")
        return self.sessions[name]

    def _healthy(self) -> None:
        if self.failed:
            refuse("QN-BATCH-001", self.first, "a write of this unit of work has failed", "begin another")

    def _identity(self, write: Write) -> tuple:
        return (write.unit or self.first, *(write.values[k] for k in self._session(write).unit.key))

    def stage(self, write: Write) -> None:
        self._healthy()
        if any(w is write for _, w in self.staged):
            refuse("QN-BATCH-002", write.unit or self.first, "the same write is staged twice", "make a new one")
        session = self._session(write)
        session._check(write.values, write.mode == "insert")
        if any(write.values.get(k) is None for k in session.unit.key):
            refuse("QN-BATCH-006", session.unit.name, "a staged write gives its key", "append rows that are numbered by the store")
        self.staged.append((self.total, write))
        self.total += 1
        if len(self.staged) >= self.max_rows:
            self.flush()

    def _state(self, name: str) -> Manifest:
        if name not in self.states:
            self.states[name] = self.store.manifest(self.sessions[name].unit, settle=True).copy()
        return self.states[name]

    def read(self, unit: str | None = None, /, **key: Any) -> dict[str, Any] | None:
        """The row as the staged writes will leave it; nothing is committed."""
        self._healthy()
        name = unit or self.first
        session = self._session(Write("", {}, unit=name))
        row = session._read(key, self.states.get(name))
        now = None if row is None else {n: row[n] for n in session.unit.visible()}
        wanted = (name, *(key[k] for k in session.unit.key))
        mine = [w for _, w in self.staged if self._identity(w) == wanted]
        if not mine:
            return now
        last = mine[-1]
        if last.mode in ("delete", "compare-and-delete"):
            return None
        if last.mode == "update" and now is None:
            return None
        return (now or {c.name: c.default for c in session.unit.columns}) | dict(last.values)

    def query(self, q: plans.Query, unit: str | None = None) -> plans.Result:
        """The unit as the staged writes will leave it: they are flushed first."""
        self.flush()
        session = self._session(Write("", {}, unit=unit))
        session._admit(q)
        return plans.run(session.df(self.states.get(session.unit.name)), q, session.access)

    def _groups(self) -> dict[str, list[list[tuple[int, Write]]]]:
        """The last write of each key, by unit, then by mode, columns and conditions."""
        last: dict[tuple, int] = {}
        for place, w in self.staged:
            key = self._identity(w)
            if key in last:
                self.superseded[last[key]] = place
            last[key] = place
        kept, groups = set(last.values()), {}
        for place, w in self.staged:
            if place in kept:
                mode = "create" if w.create_only else w.mode
                how = (mode, tuple(sorted(w.values)), w.if_version, json.dumps(w.expected, default=str, sort_keys=True))
                groups.setdefault(w.unit or self.first, {}).setdefault(how, []).append((place, w))
        return {unit: list(by.values()) for unit, by in groups.items()}

    def flush(self) -> None:
        """Merge the staged writes into states of this unit of work's own."""
        self._healthy()
        try:
            for name, groups in self._groups().items():
                session, stored = self.sessions[name], []
                for members in groups:
                    w = members[0][1]
                    frame, names = session._changes([x.values for _, x in members], "create" if w.create_only else w.mode, session._version(w.if_version), w.expected)
                    numbers = session.spark.createDataFrame([(k, place) for k, (place, _) in enumerate(members)], f"{ORDINAL} long, i long")
                    frame = frame.join(F.broadcast(numbers), ORDINAL).drop(ORDINAL).withColumnRenamed("i", ORDINAL)
                    path = f"{self.store._folder(name)}/work/{uuid.uuid4().hex}"
                    frame.write.parquet(path)
                    stored.append((path, frame.schema, names))
                self.flushed.append((name, stored))
                self._run(name, stored)
            self.staged = []
        except Exception:
            self.failed = True
            raise

    def _run(self, name: str, stored: Sequence[tuple[str, T.StructType, list[str]]]) -> None:
        session = self.sessions[name]
        changed, outcomes = session._merge(self._state(name), [(session.spark.read.schema(schema).parquet(path), names) for path, schema, names in stored], strict=True)
        if changed:
            self.changed.add(name)
        if self.exact:
            told = {r[ORDINAL]: r[OUTCOME] for r in outcomes.collect()}  # of a flush, max_rows at most
            self.outcomes |= told
            self.counts.update(told.values())
        else:
            self.counts.update({r[OUTCOME]: r["count"] for r in outcomes.groupBy(OUTCOME).count().collect()})  # a row for each outcome

    def commit(self) -> dict:
        """Counts; with exact, outcomes of every staged write too."""
        self.flush()
        try:
            for _ in range(RETRIES):
                new = [(n, replace(self.states[n], number=self.states[n].number + 1)) for n in sorted(self.changed)]
                if not new or self.store.publish_all(new):
                    break
                self.store.commands["conflicts"] += 1
                self._forget()
                for name, stored in self.flushed:
                    self._run(name, stored)
            else:
                raise Conflict(",".join(sorted(self.changed)))
        except Exception:
            self.failed = True
            raise
        out = {"submitted": self.total, "applied": sum(self.counts.values()), "superseded": len(self.superseded), **self.counts}
        if self.exact:
            out["outcomes"] = [f"Superseded:{self.superseded[i]}" if i in self.superseded else self.outcomes[i] for i in range(self.total)]
        self._begin()
        return out
