"""Additive evolution of deployed units: a plan of differences, refusals, and an atomic apply."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, replace

from pyspark.sql import functions as F

from quern.errors import Refusal, Refused
from quern.functions.text_keys import key_column
from quern.model import Unit, declare, unit_from_json, unit_json, validate_unit
from quern.plans.coverage import check
from quern.plans.query import Page, Query
from quern.predicates import TRUE, And, among, between, eq
from quern.sources.store import Store


@dataclass(frozen=True)
class Step:
    kind: str  # create, add-column, backfill, create-index, rebuild-index, publish
    subject: str


@dataclass(frozen=True)
class Plan:
    steps: tuple[Step, ...]
    refusals: tuple[Refusal, ...]


def plan(deployed: Unit | None, wanted: Unit) -> Plan:
    """Columns are only added, and are nullable or have a default; layouts may change; nothing else does."""
    bad = list(validate_unit(wanted))
    if deployed is None:
        return Plan((Step("create", wanted.name), *(Step("create-index", i.name) for i in wanted.indexes), Step("publish", wanted.name)), tuple(bad))
    add = lambda code, path, why: bad.append(Refusal(code, path, why, "declare a new unit"))
    have, want = {c.name: c for c in deployed.columns}, {c.name: c for c in wanted.columns}
    steps = []
    for name in have.keys() - want.keys():
        add("QN-SCHEMA-001", name, "a column is removed")
    for name, c in want.items():
        if name not in have:
            if not c.nullable and c.default is None:
                add("QN-SCHEMA-003", name, "an added column is nullable or has a default")
            steps.append(Step("add-column", name))
        else:
            o = have[name]
            widened = c.max_length is None or (o.max_length is not None and c.max_length >= o.max_length)
            if (o.kind, o.nullable, o.precision, o.scale, o.collation, o.generated) != (c.kind, c.nullable, c.precision, c.scale, c.collation, c.generated) or not widened:
                add("QN-SCHEMA-002", name, "a column changes")
    if deployed.key != wanted.key or deployed.scoped != wanted.scoped:
        add("QN-SCHEMA-004", wanted.name, "the key or the scoping changes")
    if wanted.version < deployed.version:
        add("QN-SCHEMA-005", wanted.name, "the deployed version is newer")
    old = {d.name: d for d in deployed.derived}
    for d in wanted.derived:
        if d.name not in old:
            steps += [Step("add-column", d.name), Step("backfill", d.name)]
        elif old[d.name] != d:
            add("QN-SCHEMA-002", d.name, "a stored key changes its algorithm")
    layouts = {i.name: i for i in deployed.indexes}
    for i in wanted.indexes:
        if i.name not in layouts:
            steps.append(Step("create-index", i.name))
        elif layouts[i.name] != i:
            steps.append(Step("rebuild-index", i.name))
    if steps or unit_json(deployed) != unit_json(wanted):
        steps.append(Step("publish", wanted.name))
    return Plan(tuple(steps), tuple(bad))


def deployed_unit(store: Store, name: str) -> Unit | None:
    found = store._last(name)
    return unit_from_json(found.unit) if found else None


def apply(store: Store, wanted: Unit) -> Plan:
    """Make the deployed unit the wanted one, or refuse. One manifest publishes it all; a concurrent writer makes it start again."""
    before = deployed_unit(store, wanted.name)
    found = plan(before, wanted)
    if found.refusals:
        raise Refused(*found.refusals)
    if before is None:
        store.create(wanted)
        return found
    if not found.steps:
        return found
    session = store.session(replace(before, scoped=False), gate=None)
    session.unit = wanted
    backfill = [d for d in wanted.derived if any(s == Step("backfill", d.name) for s in found.steps)]

    def change(manifest):
        rows = store.rows(wanted, manifest)
        if any(i.unique for i in wanted.indexes):
            session._unique(rows)
        if backfill:
            for d in backfill:
                rows = rows.withColumn(d.name, key_column(F.col(f"`{d.source}`"), d.algorithm))
            session._write(rows, manifest, sorted(manifest.data))
        manifest.unit = unit_json(wanted)
        manifest.history.append(wanted.fingerprint())
        return manifest, None

    store.commit(wanted, change)
    return found


def verify(unit: Unit, inventory: list[dict]) -> list[Refusal]:
    """Of a list of query shapes ({equal, range, order, take, total_count}) those that the unit's layouts do not cover."""
    from quern.plans.compile import Order

    out = list(validate_unit(unit))
    sample = {"string": "a", "int32": 1, "int64": 1, "boolean": True, "guid": "0" * 8 + "-0000-0000-0000-" + "0" * 12, "binary": b"a", "timestamp": dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)}
    import decimal

    sample["decimal"] = decimal.Decimal(1)
    for shape in inventory:
        terms = [eq(unit.column(c), sample[unit.column(c).kind.value]) for c in shape.get("equal", [])]
        terms += [among(unit.column(c), [sample[unit.column(c).kind.value], None]) for c in shape.get("in", [])]
        terms += [between(unit.column(c), sample[unit.column(c).kind.value]) for c in shape.get("range", [])]
        order = tuple(Order(unit.column(o["column"]), o.get("direction", "asc").startswith("d"), o.get("nulls", "first") == "first") for o in shape.get("order", []))
        q = Query(unit, And(tuple(terms)) if terms else TRUE, order, (), Page(shape.get("take"), shape.get("skip") or 0), bool(shape.get("total_count")))
        out += check(q).refusals
    return out


def load(path: str) -> Unit:
    with open(path, encoding="utf-8") as f:
        return declare(unit_from_json(json.load(f)))


def emit(unit: Unit) -> str:
    return json.dumps(unit_json(unit), indent=2, sort_keys=True)
