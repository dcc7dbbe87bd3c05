"""Transactional units: outcomes of every write, conflicts, replays, retention, evolution, records, documents, streams."""

import dataclasses
import datetime as dt
import json
import threading
import uuid
from decimal import Decimal as D

import pytest

from quern import schema
from quern.__main__ import main
from quern.documents import DocumentUnit, Documents, Projection
from quern.errors import Refused
from quern.functions import text_keys
from quern.model import SCOPE, Access, Collation, Column, Derived, Index, IndexColumn, Kind, Retention, Unit, unit_from_json, unit_json
from quern.operators.aggregate import AggregateQuery, Count, Profile
from quern.plans.coverage import Gate
from quern.plans.compile import Order
from quern.plans.query import Page, Query
from quern.predicates import StartsWith, eq
from quern.records import RecordTable, unit_of
from quern.sources.store import BatchError, Store, Write
from quern.streaming import streams

UTC = dt.timezone.utc
ITEMS = Unit("items", (Column("k", Kind.STRING, False), Column("v", Kind.INT64), Column("note", Kind.STRING)), ("k",), (Index("u", (IndexColumn("v"),), unique=True, excludes_missing=True),), versioned=True, append_window_s=600)
LOG = Unit("log", (Column("seq", Kind.INT64, False, generated="sequence"), Column("trace", Kind.STRING, False), Column("msg", Kind.STRING)), ("seq",), profiles=(Profile("by-trace", ("trace",), (Count("n"),)),), scoped=True, append_window_s=600, retention=Retention(2, "seq", ("trace",)))


class Clock:
    now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store", buckets=4, clock=Clock())


def test_writes(store):
    store.create(ITEMS)
    s = store.session(ITEMS)
    assert s.read(k="a") is None
    assert s.insert({"k": "a", "v": 1, "note": "x"}) == "Inserted"
    assert s.insert({"k": "a", "v": 2}) == "UniqueViolation"
    assert s.update({"k": "b", "v": 2}) == "NotFound"
    assert s.update({"k": "a", "v": 3}) == "Updated"
    row = s.read(k="a")
    assert (row.v, row.note, row["__quern_version"]) == (3, "x", 2)  # columns that are not given stay
    assert s.upsert({"k": "b", "v": 4}) == "Inserted"
    assert s.upsert({"k": "b", "v": 5}, if_version=7) == "VersionConflict"
    assert s.upsert({"k": "b", "v": 5}, if_version=1) == "Updated"
    assert s.upsert({"k": "c", "v": 6}, if_version=1) == "NotFound"
    assert s.upsert({"k": "b", "v": 6}, create_only=True) == "VersionConflict"
    assert s.delete(k="z") == "NotFound"
    assert s.delete(k="b", if_version=1) == "VersionConflict"
    assert s.delete(k="b", if_version=2) == "Deleted"
    assert s.compare_and_delete({"v": 9}, k="a") == "ComparisonMismatch"
    assert s.compare_and_delete({"v": 3, "note": "x"}, k="a") == "Deleted"
    assert s.df().isEmpty()
    s.insert({"k": "n"})
    assert s.compare_and_delete({"v": None}, k="n") == "Deleted"


def test_write_refusals(store):
    store.create(ITEMS)
    s = store.session(ITEMS)
    for wrong in (lambda: s.insert({"v": 1}), lambda: s.insert({"k": "a", "nope": 1}), lambda: s.insert({"k": "a", "v": "x"}), lambda: store.session(ITEMS, Access.to("a")), lambda: s.read(v=1), lambda: s.upsert({"k": "a"}, 1, True)):
        with pytest.raises(Refused):
            wrong()
    s.insert({"k": "a", "v": 1})
    with pytest.raises(Refused, match="QN-WRITE-002"):
        s.insert({"k": "b", "v": 1})
    assert s.df().count() == 1
    s.insert({"k": "b"})
    s.insert({"k": "c"})  # missing values are excluded from the unique layout


def test_concurrent_writers_lose_nothing(store):
    store.create(ITEMS)
    errors = []

    def write(i):
        try:
            store.session(ITEMS).upsert({"k": f"k{i}", "v": i})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and {r.k for r in store.session(ITEMS).df().collect()} == {f"k{i}" for i in range(4)}
    assert store.manifest(ITEMS).number == 5


def test_unit_of_work(store):
    store.create(ITEMS)
    work = store.unit_of_work(ITEMS, exact=True)
    first = Write("upsert", {"k": "a", "v": 1})
    work.stage(first)
    with pytest.raises(Refused):
        work.stage(first)
    for w in (Write("upsert", {"k": "b", "v": 2}), Write("upsert", {"k": "a", "v": 3, "note": "n"}), Write("insert", {"k": "c"})):
        work.stage(w)
    assert work.read(k="a")["v"] == 3 and work.read(k="z") is None and store.session(ITEMS).read(k="a") is None
    out = work.commit()
    assert (out["submitted"], out["applied"], out["superseded"], out["Inserted"]) == (4, 3, 1, 3)
    assert out["outcomes"] == ["Superseded:2", "Inserted", "Inserted", "Inserted"]
    bad = store.unit_of_work(ITEMS)
    bad.stage(Write("upsert", {"k": "d"}))
    bad.stage(Write("insert", {"k": "a"}))
    with pytest.raises(BatchError):
        bad.commit()
    with pytest.raises(Refused):
        bad.stage(Write("upsert", {"k": "e"}))
    assert {r.k for r in store.session(ITEMS).df().collect()} == {"a", "b", "c"}


def test_unit_of_work_flushes(store):
    store.create(ITEMS)
    work = store.unit_of_work(ITEMS, max_rows=2, exact=True)
    for w in (Write("upsert", {"k": "a", "v": 1}), Write("upsert", {"k": "a", "v": 2}), Write("upsert", {"k": "a", "note": "n"}), Write("insert", {"k": "b"}), Write("insert", {"k": "c"})):
        work.stage(w)
    assert len(work.staged) == 1 and len(work.flushed) == 2
    assert work.read(k="a") == {"k": "a", "v": 2, "note": "n"} and work.read(k="c") is not None
    assert {r.k for r in work.query(Query(ITEMS, page=Page(9))).rows} == {"a", "b", "c"}
    assert store.session(ITEMS).df().isEmpty() and store.manifest(ITEMS).number == 1
    store.session(ITEMS).upsert({"k": "z", "v": 9})  # another writer is first
    out = work.commit()
    assert out["outcomes"] == ["Superseded:1", "Inserted", "Updated", "Inserted", "Inserted"]
    assert (out["submitted"], out["applied"], out["superseded"], out["Inserted"], out["Updated"]) == (5, 4, 1, 3, 1)
    assert {(r.k, r.v, r.note) for r in store.session(ITEMS).df().collect()} == {("a", 2, "n"), ("b", None, None), ("c", None, None), ("z", 9, None)}
    bad = store.unit_of_work(ITEMS, max_rows=1)
    bad.stage(Write("insert", {"k": "y"}))
    with pytest.raises(BatchError):
        bad.stage(Write("insert", {"k": "a"}))
    for after in (bad.commit, bad.flush, lambda: bad.read(k="y"), lambda: bad.stage(Write("insert", {"k": "x"}))):
        with pytest.raises(Refused, match="BATCH-001"):
            after()
    assert store.session(ITEMS).read(k="y") is None
    with pytest.raises(Refused, match="BATCH-003"):
        store.unit_of_work(ITEMS, max_rows=0)


OTHER = dataclasses.replace(ITEMS, name="other", indexes=())


def test_unit_of_work_over_units(store):
    store.create(ITEMS), store.create(OTHER), store.create(LOG)
    work = store.unit_of_work([ITEMS, OTHER], exact=True)
    for w in (Write("insert", {"k": "a", "v": 1}), Write("insert", {"k": "a", "v": 1}, unit="other"), Write("insert", {"k": "b"}, unit="other")):
        work.stage(w)
    with pytest.raises(Refused, match="BATCH-005"):
        work.stage(Write("insert", {"k": "a"}, unit="log"))
    assert work.read("other", k="b") is not None and work.read(k="b") is None
    assert work.commit()["outcomes"] == ["Inserted"] * 3
    assert store.session(ITEMS).df().count() == 1 and store.session(OTHER).df().count() == 2
    # a failure in one unit leaves the other as it was
    work = store.unit_of_work([ITEMS, OTHER])
    work.stage(Write("upsert", {"k": "q"})), work.stage(Write("insert", {"k": "b"}, unit="other"))
    with pytest.raises(BatchError):
        work.commit()
    assert store.session(ITEMS).read(k="q") is None
    with pytest.raises(Refused, match="BATCH-004"):
        store.unit_of_work([ITEMS, ITEMS])
    with pytest.raises(Refused, match="BATCH-006"):
        store.unit_of_work(LOG, Access.to("a")).stage(Write("insert", {"trace": "x"}))


def test_undecided_states_do_not_count(store, monkeypatch):
    """A unit of work that stops before its decision is not seen, holds writers up for a while, and is then undone as a whole."""
    monkeypatch.setattr("quern.sources.store.PATIENCE_S", 0.2)
    store.create(ITEMS), store.create(OTHER)

    def staged():
        work = store.unit_of_work([ITEMS, OTHER])
        work.stage(Write("insert", {"k": "a", "v": 1})), work.stage(Write("insert", {"k": "a"}, unit="other"))
        return work

    stopped, create = staged(), store.files.create
    monkeypatch.setattr(store.files, "create", lambda path, text: (_ for _ in ()).throw(OSError()) if "_decisions" in path else create(path, text))
    with pytest.raises(OSError):
        stopped.commit()
    monkeypatch.undo()
    monkeypatch.setattr("quern.sources.store.PATIENCE_S", 0.2)
    assert store.session(ITEMS).read(k="a") is None and store.session(OTHER).df().isEmpty()
    assert store.session(ITEMS).insert({"k": "b"}) == "Inserted"
    assert store.session(OTHER).df().isEmpty() and [r.k for r in store.session(ITEMS).df().collect()] == ["b"]
    # decided against between its manifests and its decision: it is made again on the newest states
    late, calls = staged(), []

    def first_loses(path, text):
        if "_decisions" in path and not calls:
            calls.append(path)
            create(path, "abandoned")
        return create(path, text)

    monkeypatch.setattr(store.files, "create", first_loses)
    assert late.commit()["Inserted"] == 2 and store.commands["conflicts"] == 1
    assert {r.k for r in store.session(ITEMS).df().collect()} == {"a", "b"} and store.session(OTHER).read(k="a") is not None


def test_appends_replay(store):
    store.create(ITEMS)
    s = store.session(ITEMS)
    rows = [{"k": "a", "v": 1}, {"k": "b", "v": 2}]
    assert s.append("op", rows) == "Inserted"
    assert s.append("op", [{"k": "z"}]) == "Replayed"
    with pytest.raises(BatchError):
        s.append("other", [{"k": "a"}])
    with pytest.raises(Refused, match="APPEND-006"):
        s.append("twice", [{"k": "y"}, {"k": "y"}])
    with pytest.raises(Refused, match="APPEND-002"):
        s.append_with_outcomes("op", rows)
    store.clock.now += 601
    with pytest.raises(BatchError):
        s.append("op", rows)  # expired: it is a new operation
    assert s.append("new", [{"k": "q"}]) == "Inserted" and len(store.manifest(ITEMS).ledger) == 1


def test_sequence_log(store):
    store.create(LOG)
    a, b = store.session(LOG, Access.to("a")), store.session(LOG, Access.to("b"))
    assert a.inspect()["high_water"] is None
    rows = [{"trace": t, "msg": str(i)} for i, t in enumerate("xxxyy")]
    first = a.append_with_outcomes("op", rows)
    assert [r["seq"] for r in first] == [1, 2, 3, 4, 5] and a.append_with_outcomes("op", rows) == first
    with pytest.raises(Refused, match="APPEND-001"):
        a.append_with_outcomes("op", rows[:1])
    assert b.append_with_outcomes("op", rows[:1])[0]["seq"] == 6  # the ledger is of a scope, numbers are of the unit
    assert a.apply_retention() == {"deleted": 1, "batches": 1, "stopped": False}
    assert sorted(r.seq for r in a.df().collect()) == [2, 3, 4, 5] and b.df().count() == 1
    assert a.apply_retention(0, operation="wipe") == {"deleted": 4, "batches": 1, "stopped": False} == a.apply_retention(0, operation="wipe")
    with pytest.raises(Refused, match="APPEND-001"):
        a.apply_retention(1, operation="wipe")
    assert a.inspect()["high_water"] == 5 and b.inspect()["high_water"] == 6
    assert b.aggregate(AggregateQuery("by-trace")).rows[0].n == 1


def test_scopes(store):
    seen = []
    store.audit = seen.append
    store.create(LOG)
    for scope in "ab":
        store.session(LOG, Access.to(scope)).append_rows([{"trace": scope}])
    across = store.session(LOG, Access.across("me", "audit"))
    q = Query(LOG, order=(Order(LOG.column("seq")),), page=Page(1, keyset=True))
    first = across.query_across(q)
    assert first.rows[0][SCOPE] == "a" and len(seen) == 1 and seen[0]["purpose"] == "audit"
    second = across.query_across(Query(LOG, order=q.order, page=Page(1, 0, True, first.next_token)))
    assert second.rows[0][SCOPE] == "b" and second.next_token is None
    with pytest.raises(Refused, match="TOKEN"):
        store.session(LOG, Access.across("you", "audit")).query_across(Query(LOG, order=q.order, page=Page(1, 0, True, first.next_token)))
    for wrong in (lambda: across.query(q), lambda: across.insert({"trace": "x"}), lambda: store.session(LOG), lambda: store.session(LOG, Access.to("a")).query_across(q)):
        with pytest.raises(Refused, match="SCOPE"):
            wrong()
    assert [r.trace for r in store.session(LOG, Access.to("b")).query(Query(LOG, page=Page(9))).rows] == ["b"]
    gate = Gate(LOG.indexes)
    with pytest.raises(Refused, match="COVER"):
        store.session(LOG, Access.to("b"), gate).query(Query(LOG, page=Page(9)))


def test_vacuum_and_files(store):
    store.create(ITEMS)
    s = store.session(ITEMS)
    s.upsert({"k": "a", "v": 1}), s.upsert({"k": "a", "v": 2})
    assert store.inspect_files(ITEMS) == [] and store.vacuum() == 0
    assert store.vacuum(-1.0) == 3  # the first state's data, and both merges
    assert store.session(ITEMS).read(k="a").v == 2


def test_schema_evolution(store, tmp_path, capsys):
    v1 = Unit("doc", (Column("k", Kind.INT64, False), Column("name", Kind.STRING, collation=Collation.UNICODE_IGNORE_CASE)), ("k",))
    store.create(v1)
    store.session(v1).append_rows([{"k": 1, "name": "Straße"}, {"k": 2, "name": None}])
    v2 = Unit("doc", (*v1.columns, Column("n", Kind.INT32, False, default=7)), ("k",), (Index("i", (IndexColumn("n"),)),), (Derived("name_key", "name", text_keys.UNICODE_FOLD),), version=2)
    found = schema.plan(v1, v2)
    assert [s.kind for s in found.steps] == ["add-column", "add-column", "backfill", "create-index", "publish"] and not found.refusals
    with pytest.raises(Refused, match="RUNTIME-001"):
        store.session(v2)
    schema.apply(store, v2)
    assert not schema.apply(store, v2).steps
    s = store.session(v2)
    assert {(r.k, r.n) for r in s.df().collect()} == {(1, 7), (2, 7)}
    s.insert({"k": 3, "name": "STRASSE"})
    rows = s.query(Query(v2, StartsWith(v2.column("name"), "sTRAß"), page=Page(5))).rows
    assert [r.k for r in rows] == [1]
    assert store.admit(Unit("doc", v2.columns, ("k",), (Index("i", (IndexColumn("n", True),)),)))[0].code == "QN-RUNTIME-002"
    for worse, code in (
        (Unit("doc", v2.columns[:2], ("k",)), "001"),
        (Unit("doc", (Column("k", Kind.INT32, False), *v2.columns[1:]), ("k",)), "002"),
        (Unit("doc", (*v2.columns, Column("z", Kind.INT32, False)), ("k",)), "003"),
        (Unit("doc", v2.columns, ("k", "n"), version=2), "004"),
        (v1, "005"),
    ):
        assert f"QN-SCHEMA-{code}" in {r.code for r in schema.plan(v2, worse).refusals}
    assert unit_from_json(json.loads(json.dumps(unit_json(v2)))) == v2
    (tmp_path / "u.json").write_text(schema.emit(v2))
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"equal": ["n"]}, {"equal": ["name"]}]}))
    assert main(["schema", "validate", str(tmp_path / "u.json")]) == 0
    assert main(["schema", "validate", str(tmp_path / "u.json"), "--inventory", str(tmp_path / "q.json")]) == 1
    assert main(["schema", "plan", str(tmp_path / "u.json"), "--root", f"file://{tmp_path}/new"]) == 0
    assert main(["schema", "apply", str(tmp_path / "u.json"), "--root", f"file://{tmp_path}/new"]) == 0
    assert main(["schema", "status", str(tmp_path / "u.json"), "--root", f"file://{tmp_path}/new"]) == 0
    assert "current" in capsys.readouterr().out


@dataclasses.dataclass
class Person:
    id: uuid.UUID
    name: str
    born: dt.datetime | None = None
    weight: D | None = None


@dataclasses.dataclass
class Name:
    name: str


def test_records(store):
    unit = unit_of(Person, "people", ("id",))
    store.create(unit)
    table = RecordTable(Person, store.session(unit))
    p = Person(uuid.uuid4(), "Ada", dt.datetime(1815, 12, 10, tzinfo=UTC), D("1.5000"))
    assert table.insert(p) == "Inserted" and table.get(id=str(p.id)) == p
    assert table.upsert(dataclasses.replace(p, name="Lovelace")) == "Updated"
    q = table.query()
    assert [r.name for r in table.records(q.where(q.row.name == "Lovelace").take(5))] == ["Lovelace"]
    assert table.project(Name, table.query().take(1)) == [Name("Lovelace")]
    assert table.delete(id=str(p.id)) == "Deleted" and table.get(id=str(p.id)) is None
    with pytest.raises(Refused):
        unit_of(dataclasses.make_dataclass("X", [("a", list)]), "x", ("a",))


def test_documents(store):
    old = DocumentUnit("docs", (Projection(Column("title", Kind.STRING), "head.title"),))
    store.create(old.unit())
    d = Documents(old, store.session(old.unit()))
    assert d.insert("1", {"z": 1, "head": {"title": "T"}}) == "Inserted" and d.get("1") == {"head": {"title": "T"}, "z": 1}
    new = dataclasses.replace(old, version=2, upcasters={1: lambda b: b | {"z": b["z"] + 1}})
    d2 = Documents(new, store.session(new.unit()))
    d2.save("2", {"z": 5})
    assert d2.get("1")["z"] == 2 and d2.get("2") == {"z": 5}
    bodies = {r.id: json.loads(r.body)["z"] for r in d2.upcast(d2.query().to_df()).collect()}
    assert bodies == {"1": 2, "2": 5}
    assert d2.query().where(d2.query().row.title == "T").count() == 1 and d2.delete("1") == "Deleted"
    with pytest.raises(Refused):
        dataclasses.replace(old, version=3).unit()


def test_streams(spark, store, tmp_path):
    src = str(tmp_path / "in")
    t = dt.datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(i, f"u{i % 2}", t + dt.timedelta(minutes=i * 7)) for i in range(20)]
    spark.createDataFrame(rows, "id long, user string, ts timestamp").repartition(3).write.parquet(src)
    unit = Unit("ev", (Column("id", Kind.INT64, False), Column("user", Kind.STRING), Column("ts", Kind.TIMESTAMP)), ("id",), append_window_s=600)
    store.create(unit)
    read = lambda: spark.readStream.schema("id long, user string, ts timestamp").parquet(src)
    for _ in range(2):  # the second run finds nothing new
        streams.append_stream(store.session(unit), read(), str(tmp_path / "cp"), "ev").awaitTermination()
    assert store.session(unit).df().count() == 20

    def final(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name).collect()

    got = {r.bucket.replace(tzinfo=UTC): r.n for r in final(streams.bucket_counts(read(), "ts", dt.timedelta(hours=1), dt.timedelta(minutes=1)), "complete", "b1")}
    want = {}
    for _, _, ts in rows:
        want[ts.replace(minute=0)] = want.get(ts.replace(minute=0), 0) + 1
    assert got == want
    latest = {r.user: r.id for r in final(streams.latest_per_key(read(), unit, "user", "ts"), "complete", "b2")}
    assert latest == {"u0": 18, "u1": 19}
    assert len(final(streams.without_repeats(read(), ["user"], "ts", dt.timedelta(days=1)), "append", "b3")) == 2
    assert sum(r.n for r in final(streams.sessions(read(), "ts", "user", dt.timedelta(minutes=15), dt.timedelta(minutes=1)), "complete", "b4")) == 20


def test_sources(spark, tmp_path):
    from quern.sources.files import read

    unit = Unit("s", (Column("id", Kind.INT64, False), Column("x", Kind.DECIMAL)), ("id",))
    df = spark.createDataFrame([(1, 2.5)], "id int, x double")
    for form in ("parquet", "orc", "json", "csv"):
        df.write.format(form).save(str(tmp_path / form))
        assert read(spark, unit, str(tmp_path / form), form).first().x == D("2.5000")
    assert eq(unit.column("x"), D("2.5"))
