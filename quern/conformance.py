"""Queries for what the engine promises beside plain reading: refusals, budgets, admission, writes, records, documents, streams.

Each runs over its whole table and is compared with SQL. Where a promise is a refusal, the query returns
a row for each case with the code it got.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import shutil
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema
from quern.documents import DocumentUnit, Documents, Projection
from quern.errors import Refused
from quern.functions import identity, text_keys
from quern.model import SCOPE, Access, Constant, Derived, Index, IndexColumn, Kind, Retention, Unit, validate_unit
from quern.operators import aggregate as agg
from quern.operators.aggregate import AggregateQuery, Count, FixedBucket, Having, LocalDay, Max, Min, Profile, SetUnion, Sum
from quern.operators.fluent import Rows, Table
from quern.plans import coverage
from quern.plans import query as plans
from quern.plans.compile import Order
from quern.plans.query import Latest, Page, Query, Scan
from quern.predicates import FALSE, And, Not, Or, Predicate, Range, StartsWith, Substring, among, between, eq, evaluate
from quern.queries import CUSTOMER, EVENTS, LINEITEM, ORDERS, PART, SCOPED_CUSTOMER, UTC, D, _filled, _store, c, col, event_stream, load, shown
from quern.records import RecordTable, unit_of
from quern.session import work_folder
from quern.sources import files
from quern.sources.store import BatchError, Store, Write
from quern.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def told(f: Callable[[], object]) -> str:
    """The code of a refusal, or what came back."""
    try:
        out = f()
    except Refused as e:
        return e.code
    except BatchError as e:
        return "failed: " + ",".join(sorted(r["__quern_outcome"] for r in e.outcomes))
    return out if isinstance(out, str) else "ok"


def cases(spark: SparkSession, found: dict[str, Callable[[], object]]) -> DataFrame:
    return spark.createDataFrame([(k, told(f)) for k, f in found.items()], "what string, told string")


def values(*rows: tuple[str, str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b if b.startswith('(') else repr(b)})" for a, b in rows) + ") t(what, told)"


def unit_like(unit: Unit, name: str, **changes) -> Unit:
    return replace(unit, name=name, **changes)


def filled(spark: SparkSession, sf_dir: str, unit: Unit, source: Unit):
    """A unit of another name in a new store, filled with the rows of a table."""
    store = _store(spark)
    store.create(unit)
    s = store.session(unit)
    s.append_rows(load(spark, sf_dir, source).select(*(f"`{x.name}`" for x in unit.columns)))
    return store, s


# providers, sessions, sources

NATION = Unit("nation", (col("n_nationkey", Kind.INT32, False), col("n_name", Kind.STRING), col("n_regionkey", Kind.INT32)), ("n_nationkey",))


@query("SELECT c_custkey, c_name, c_mktsegment, 1::bigint AS version FROM customer WHERE c_custkey = 42")
def point_read(spark, sf_dir):
    """By the whole key: one bucket of the store is read."""
    _, s = _filled(spark, sf_dir, CUSTOMER)
    row = s.read(c_custkey=42)
    held = [] if row is None else [(row.c_custkey, row.c_name, row.c_mktsegment, row["__quern_version"])]
    return spark.createDataFrame(held, "c_custkey long, c_name string, c_mktsegment string, version long")


@query("SELECT c_custkey, c_name FROM customer")
def reopened_store(spark, sf_dir):
    """What one connection committed another one reads."""
    store, _ = _filled(spark, sf_dir, CUSTOMER)
    return Store(spark, store.root, buckets=8).session(CUSTOMER).df().select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES ('ix_ts', 0, 'ts', true), ('ix_ts', 1, 'event_id', false), ('ix_type_ts', 0, 'event_type', false), ('ix_type_ts', 1, 'ts', false)) t(layout, place, name, descending)")
def catalog_read(spark, sf_dir):
    store = _store(spark)
    store.create(EVENTS)
    return spark.createDataFrame([(i.name, k, x.name, x.descending) for i in store.indexes("events") for k, x in enumerate(i.columns)], "layout string, place int, name string, descending boolean")


@query("SELECT 'auditor' AS identity, 'yearly review' AS purpose, count(*) AS total FROM customer WHERE c_nationkey = 3")
def audit_record(spark, sf_dir):
    seen: list[dict] = []
    store = _store(spark)
    store.audit = seen.append
    store.create(SCOPED_CUSTOMER)
    for scope in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        store.session(SCOPED_CUSTOMER, Access.to(scope)).append_rows(load(spark, sf_dir, SCOPED_CUSTOMER).where(F.col("c_mktsegment") == scope))
    q = Query(SCOPED_CUSTOMER, eq(SCOPED_CUSTOMER.column("c_nationkey"), 3), page=Page(1), total_count=True)
    total = store.session(SCOPED_CUSTOMER, Access.across("auditor", "yearly review")).query_across(q).total_count
    return spark.createDataFrame([(r["identity"], r["purpose"], total) for r in seen], "identity string, purpose string, total long")


@query("SELECT n_nationkey, n_name FROM nation WHERE (n_regionkey = 1 OR ends_with(n_name, '7')) AND NOT n_nationkey < 3")
def evaluator_definition(spark, sf_dir):
    """The algebra's definition in Python, on a table of fixed size."""
    n = {x.name: x for x in NATION.columns}
    p = And((Or((eq(n["n_regionkey"], 1), Substring(n["n_name"], "7", True))), Not(between(n["n_nationkey"], None, 3, True, False))))
    held = [r.asDict() for r in load(spark, sf_dir, NATION).collect()]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in held if evaluate(p, r)], "n_nationkey int, n_name string")


@query("SELECT format, p_partkey, p_brand, cast(p_retailprice AS double) AS p_retailprice FROM part, (VALUES ('parquet'), ('orc'), ('json'), ('csv')) f(format)")
def file_formats(spark, sf_dir):
    folder, out = work_folder(spark), None
    names = [x.name for x in PART.columns]
    for form in ("parquet", "orc", "json", "csv"):
        load(spark, sf_dir, PART).select(*names).write.format(form).save(f"{folder}/{form}")
        one = files.read(spark, replace(PART, element_sets=()), f"{folder}/{form}", form).select(F.lit(form).alias("format"), "p_partkey", "p_brand", "p_retailprice")
        out = one if out is None else out.unionAll(one)
    return shown(out)


def _derby(spark: SparkSession, df: DataFrame, table: str) -> dict[str, str]:
    """A small frame as a table of a read-only Derby database; access to it from every process of the session.

    An embedded database opens in one process at a time unless it is read-only, and processes may share no disk: the
    database is made in the driver and goes to the executors in a jar, which Derby opens by the class path.
    """
    folder, name, jvm = tempfile.mkdtemp(prefix="quern-"), f"q{uuid.uuid4().hex}", spark.sparkContext._jvm
    driver, kinds = "org.apache.derby.jdbc.EmbeddedDriver", {"int": "INTEGER", "string": "VARCHAR(32672)"}
    open_ = lambda more: jvm.org.apache.derby.jdbc.EmbeddedDriver().connect(f"jdbc:derby:{folder}/{name};{more}", jvm.java.util.Properties())
    con = open_("create=true")
    con.createStatement().executeUpdate(f"CREATE TABLE {table} (" + ", ".join(f'"{n}" {kinds[kind]}' for n, kind in df.dtypes) + ")")
    put = con.prepareStatement(f"INSERT INTO {table} VALUES ({', '.join('?' * len(df.columns))})")
    for r in df.collect():
        for i, v in enumerate(r):
            put.setObject(i + 1, v)
        put.executeUpdate()
    con.close()
    try:
        open_("shutdown=true")
    except Py4JJavaError as e:  # how Derby says that it has closed the database
        if e.java_exception.getSQLState() != "08006":
            raise
    spark.sql(f"ADD JAR '{shutil.make_archive(f'{folder}/{name}', 'zip', folder, name)}'")
    return {"url": f"jdbc:derby:classpath:{name}", "dbtable": table, "driver": driver}


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)")
def jdbc_source(spark, sf_dir):
    """A relational database read by its driver, with the filter pushed into it; the tasks that read it run on the executors."""
    unit = replace(NATION, name="nations")
    access = _derby(spark, load(spark, sf_dir, NATION).select(*(x.name for x in NATION.columns)), "nations")
    found = files.read(spark, unit, "", "jdbc", **access)
    return plans.plan(found, Query(unit, among(unit.column("n_regionkey"), [1, 3]), columns=("n_nationkey", "n_name")))


# canonical forms, constants


@query(values(("order of terms", "same"), ("double negation", "same"), ("repeated term", "same"), ("other value", "another"), ("shape of another value", "same"), ("another page", "same"), ("columns", "another")))
def canonical_forms(spark, sf_dir):
    a, b = eq(c["o_orderstatus"], "F"), between(c["o_totalprice"], D(100))
    q = Query(ORDERS, And((a, b)))
    same = lambda x, y: "same" if x == y else "another"
    of = lambda p: Query(ORDERS, p).fingerprint()
    return cases(
        spark,
        {
            "order of terms": lambda: same(q.fingerprint(), of(And((b, a)))),
            "double negation": lambda: same(q.fingerprint(), of(Not(Not(And((a, b)))))),
            "repeated term": lambda: same(q.fingerprint(), of(And((a, b, a)))),
            "other value": lambda: same(q.fingerprint(), of(And((eq(c["o_orderstatus"], "O"), b)))),
            "shape of another value": lambda: same(q.fingerprint(False), Query(ORDERS, And((eq(c["o_orderstatus"], "O"), b))).fingerprint(False)),
            "another page": lambda: same(q.fingerprint(), replace(q, page=Page(5)).fingerprint()),
            "columns": lambda: same(q.fingerprint(), replace(q, columns=("o_orderkey",)).fingerprint()),
        },
    )


@query("SELECT p_type, row_number() OVER (ORDER BY p_type) AS place FROM (SELECT DISTINCT p_type FROM part)")
def constant_order(spark, sf_dir):
    """Constants compare as their columns do: the types of parts in the order of their constants."""
    held = [r[0] for r in load(spark, sf_dir, PART).select("p_type").distinct().collect()]  # a fixed vocabulary
    ordered = sorted((Constant.of(c["p_type"], v) for v in held), key=Constant.order_key)
    return spark.createDataFrame([(x.value, i) for i, x in enumerate(ordered, 1)], "p_type string, place long")


@query(values(("text for a number", "QN-TYPE-001"), ("too large", "QN-TYPE-001"), ("a time without zone", "QN-TYPE-001"), ("in range", "ok")))
def constant_binding(spark, sf_dir):
    bound = {"text for a number": ("l_linenumber", "x"), "too large": ("l_linenumber", 1 << 40), "a time without zone": ("l_shipdate", dt.datetime(2024, 1, 1)), "in range": ("l_linenumber", 7)}
    return cases(spark, {k: lambda n=n, v=v: Constant.of(c[n], v) and None for k, (n, v) in bound.items()})


# scopes

_SCOPED_ORDERS = unit_like(ORDERS, "scoped_orders", scoped=True, indexes=())


@query("SELECT o_orderkey, o_custkey, o_orderpriority AS scope, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_across_scopes(spark, sf_dir):
    """The newest order of each customer, in each scope for itself."""
    df = load(spark, sf_dir, ORDERS).withColumn(SCOPE, F.col("o_orderpriority"))
    q = Query(_SCOPED_ORDERS, latest=Latest(c["o_custkey"], c["o_orderdate"]), columns=("o_orderkey", "o_custkey", "o_orderdate"))
    return shown(plans.plan(df, q, Access.across("auditor", "yearly review")).withColumnRenamed(SCOPE, "scope"))


@query(values(("scoped unit without a scope", "QN-SCOPE-003"), ("plain unit with a scope", "QN-SCOPE-003"), ("privileged write", "QN-SCOPE-004"), ("plain session across", "QN-SCOPE-005"), ("no purpose", "QN-SCOPE-002"), ("token of another auditor", "QN-TOKEN-001"), ("own token", "ok")))
def scope_refusals(spark, sf_dir):
    store = _store(spark)
    store.create(SCOPED_CUSTOMER), store.create(CUSTOMER)
    store.session(SCOPED_CUSTOMER, Access.to("BUILDING")).append_rows(load(spark, sf_dir, SCOPED_CUSTOMER).where("c_mktsegment = 'BUILDING'"))
    own, other = Access.across("auditor", "review"), Access.across("someone", "review")
    q = Query(SCOPED_CUSTOMER, order=(Order(SCOPED_CUSTOMER.column("c_name")),), columns=("c_custkey", "c_name"), page=Page(3, keyset=True))
    token = store.session(SCOPED_CUSTOMER, own).query_across(q).next_token
    following = replace(q, page=Page(3, 0, True, token))
    return cases(
        spark,
        {
            "scoped unit without a scope": lambda: store.session(SCOPED_CUSTOMER),
            "plain unit with a scope": lambda: store.session(CUSTOMER, Access.to("a")),
            "privileged write": lambda: store.session(SCOPED_CUSTOMER, own).delete(c_custkey=1),
            "plain session across": lambda: store.session(SCOPED_CUSTOMER, Access.to("BUILDING")).query_across(q),
            "no purpose": lambda: Access.across("auditor", " "),
            "token of another auditor": lambda: store.session(SCOPED_CUSTOMER, other).query_across(following),
            "own token": lambda: store.session(SCOPED_CUSTOMER, own).query_across(following) and None,
        },
    )


# aggregation with its budgets

_TESTED = unit_like(
    LINEITEM,
    "tested",
    columns=tuple(replace(x, nullable=True) if x.name == "l_shipdate" else x for x in LINEITEM.columns),
    profiles=(
        Profile("by-flag", ("l_returnflag", "l_linestatus"), (Count("n"), Sum("sum_qty", "l_quantity"), Min("min_ship", "l_shipdate"), Max("max_ship", "l_shipdate")), {"n": ("range",)}, 16, 10**9),
        Profile("few-groups", ("l_suppkey",), (Count("n"),), {}, 5, 10**9),
        Profile("few-rows", ("l_returnflag",), (Count("n"),), {}, 16, 100),
        Profile("few-values", ("l_linestatus",), (SetUnion("flags", "l_returnflag", 1),), {"flags": ("contains",)}, 16, 10**9),
        Profile("overflow", (), (Sum("s", "l_orderkey"),), {}, 16, 10**9),
        Profile("monthly", (FixedBucket("bucket", "l_shipdate", dt.timedelta(days=28)),), (Count("n"),), {}, 10_000, 10**9),
        Profile("whole", (), (Count("n"), Sum("lines", "l_linenumber"), Max("last", "l_shipdate")), {}, 1, 10**9),
    ),
)


def budgeted(spark: SparkSession, df: DataFrame, unit: Unit, q: AggregateQuery, kinds: str, access: Access = Access()) -> DataFrame:
    """Through the budgets: one grouped job, whose rows are within max_groups."""
    held = agg.run(df, unit, unit.profile(q.profile), q, access).rows
    return shown(spark.createDataFrame(held, kinds)) if held else spark.createDataFrame([], kinds)


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS decimal(18,4))) AS double) AS sum_qty, min(l_shipdate) AS min_ship, max(l_shipdate) AS max_ship FROM lineitem GROUP BY ALL")
def agg_within_budgets(spark, sf_dir):
    return budgeted(spark, load(spark, sf_dir, LINEITEM), _TESTED, AggregateQuery("by-flag"), "l_returnflag string, l_linestatus string, n long, sum_qty decimal(38,4), min_ship timestamp, max_ship timestamp")


@query("SELECT count(*) AS n, cast(sum(l_linenumber) AS bigint) AS lines, max(l_shipdate) AS last FROM lineitem")
def agg_without_groups(spark, sf_dir):
    return budgeted(spark, load(spark, sf_dir, LINEITEM), _TESTED, AggregateQuery("whole"), "n long, lines long, last timestamp")


@query(
    values(
        ("groups", "(SELECT CASE WHEN count(DISTINCT l_suppkey) > 5 THEN 'QN-AGG-BOUND-005' ELSE 'ok' END FROM lineitem)"),
        ("input rows", "(SELECT CASE WHEN count(*) > 100 THEN 'QN-AGG-BOUND-004' ELSE 'ok' END FROM lineitem)"),
        ("values", "(SELECT CASE WHEN max(n) > 1 THEN 'QN-AGG-BOUND-007' ELSE 'ok' END FROM (SELECT count(DISTINCT l_returnflag) AS n FROM lineitem GROUP BY l_linestatus))"),
        ("overflow", "QN-AGG-SUM-001"),
        ("within", "ok"),
    )
)
def agg_budget_refusals(spark, sf_dir):
    """Budgets refuse and never cut."""
    df = load(spark, sf_dir, LINEITEM)
    huge = df.withColumn("l_orderkey", F.lit(1 << 62))
    run = lambda name, frame=df: agg.run(frame, _TESTED, _TESTED.profile(name), AggregateQuery(name))
    return cases(spark, {"groups": lambda: run("few-groups"), "input rows": lambda: run("few-rows"), "values": lambda: run("few-values"), "overflow": lambda: run("overflow", huge), "within": lambda: run("by-flag")})


@query(
    values(
        ("prefix", "QN-AGG-PRED-001"), ("operator not allowed", "QN-AGG-PRED-003"), ("contains on a count", "QN-AGG-PRED-003"), ("order by a set", "QN-AGG-ORDER-001"), ("take beyond the groups", "QN-AGG-TAKE-001"),
        ("zone of a fixed bucket", "QN-AGG-ZONE-001"), ("time range without a bucket", "QN-AGG-RANGE-001"), ("across scopes", "QN-AGG-SCOPE-001"), ("alias twice", "QN-AGG-DECL-002"), ("sum of text", "QN-AGG-DECL-010"),
        ("two buckets", "QN-AGG-DECL-004"), ("no aggregates", "QN-AGG-DECL-001"), ("allowance of no output", "QN-AGG-DECL-013"), ("allowed", "ok"),
    )
)
def agg_validation(spark, sf_dir):
    df = load(spark, sf_dir, LINEITEM)
    ask = lambda name, access=Access(), **how: lambda: agg.plan(df, _TESTED, _TESTED.profile(name), AggregateQuery(name, **how), access) and None
    declare = lambda groups, reducers, allowed=None: lambda: agg.validate_profile(Profile("p", groups, reducers, allowed or {}), _TESTED)
    bucket = FixedBucket("b", "l_shipdate", dt.timedelta(days=1))
    return cases(
        spark,
        {
            "prefix": ask("by-flag", where=StartsWith(c["l_returnflag"], "R")),
            "operator not allowed": ask("by-flag", having=(Having("sum_qty", "range", (1, 2)),)),
            "contains on a count": ask("by-flag", having=(Having("n", "contains", (1,)),)),
            "order by a set": ask("few-values", order=(("flags", False),)),
            "take beyond the groups": ask("by-flag", take=17),
            "zone of a fixed bucket": ask("monthly", zone="UTC"),
            "time range without a bucket": ask("by-flag", time_from=dt.datetime(2024, 1, 1, tzinfo=UTC)),
            "across scopes": ask("by-flag", Access.across("a", "b")),
            "alias twice": declare((), (Count("n"), Count("n"))),
            "sum of text": declare((), (Sum("s", "l_returnflag"),)),
            "two buckets": declare((bucket, replace(bucket, alias="b2")), (Count("n"),)),
            "no aggregates": declare(("l_returnflag",), ()),
            "allowance of no output": declare((), (Count("n"),), {"nope": ("=",)}),
            "allowed": ask("by-flag", having=(Having("n", "range", (1, 2)),)),
        },
    )


@query(values(("another value, shape", "same"), ("another value, value", "another"), ("another order, shape", "another")))
def agg_fingerprints(spark, sf_dir):
    p = _TESTED.profile("by-flag")
    of = lambda v, values_, **how: agg.fingerprint(AggregateQuery("by-flag", eq(c["l_returnflag"], v), **how), p, Access(), values_)
    same = lambda x, y: lambda: "same" if x == y else "another"
    return cases(spark, {"another value, shape": same(of("R", False), of("A", False)), "another value, value": same(of("R", True), of("A", True)), "another order, shape": same(of("R", False), of("R", False, order=(("n", True),)))})


_BY_NATION = unit_like(SCOPED_CUSTOMER, "customers_by_nation", profiles=(Profile("by-nation", ("c_nationkey",), (Count("n"), Max("high", "c_acctbal")), {}, 100, 10**9),))


@query("SELECT c_nationkey, count(*) AS n, cast(max(cast(c_acctbal AS decimal(18,4))) AS double) AS high FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY c_nationkey")
def agg_scoped(spark, sf_dir):
    return budgeted(spark, load(spark, sf_dir, SCOPED_CUSTOMER), _BY_NATION, AggregateQuery("by-nation"), "c_nationkey int, n long, high decimal(18,4)", Access.to("MACHINERY"))


@query("SELECT time_bucket(INTERVAL 28 DAYS, l_shipdate, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def bucket_null_times(spark, sf_dir):
    """Rows without a time are in no bucket."""
    df = load(spark, sf_dir, LINEITEM).withColumn("l_shipdate", F.when(F.col("l_returnflag") != "R", F.col("l_shipdate")))
    return shown(agg.plan(df, _TESTED, _TESTED.profile("monthly"), AggregateQuery("monthly")))


_DAILY = unit_like(EVENTS, "daily_events", profiles=(Profile("daily", (LocalDay("day", "ts"),), (Count("n"),), {}, 10_000, 10**9),))


@query(
    "WITH e AS (SELECT ts + INTERVAL 50 DAYS AS ts FROM events), o AS (SELECT ts, CASE WHEN ts >= TIMESTAMP '2024-03-10 07:00:00' THEN 4 ELSE 5 END AS h FROM e), "
    "d AS (SELECT date_trunc('day', ts - to_hours(h)) AS l FROM o) SELECT l + CASE WHEN l > TIMESTAMP '2024-03-10' THEN INTERVAL 4 HOURS ELSE INTERVAL 5 HOURS END AS day, count(*) AS n FROM d GROUP BY ALL"
)
def bucket_local_day_dst(spark, sf_dir):
    """Days of New York around the spring change of 2024, one of them 23 hours long."""
    df = load(spark, sf_dir, EVENTS).withColumn("ts", F.col("ts") + F.expr("INTERVAL 50 DAYS"))
    return shown(agg.plan(df, _DAILY, _DAILY.profile("daily"), AggregateQuery("daily", zone="America/New_York")))


# text keys, identities


@query("SELECT p_partkey, regexp_replace(hex(p_brand), '(..)', '00\\1|', 'g') AS units FROM part")
def boundary_keys(spark, sf_dir):
    return load(spark, sf_dir, PART).select("p_partkey", text_keys.boundary_key(F.col("p_brand")).alias("units"))


@query("SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def successor_range(spark, sf_dir):
    """A prefix as a range of stored keys, from the prefix's key to its successor."""
    low = text_keys.key_text("Brand#1", text_keys.UTF16)
    key = text_keys.utf16_key(F.col("p_brand"))
    return load(spark, sf_dir, PART).where((key >= low) & (key < text_keys.successor(low))).select("p_partkey", "p_brand")


@query(values(("no such algorithm", "QN-KEY-002"), ("other algorithm deployed", "QN-RUNTIME-001"), ("deployed", "ok")))
def key_algorithms(spark, sf_dir):
    unit = Unit("keyed", (col("p_partkey", Kind.INT64, False), col("p_brand", Kind.STRING)), ("p_partkey",), derived=(Derived("brand_key", "p_brand", text_keys.ASCII_FOLD),))
    store = _store(spark)
    store.create(unit)
    return cases(
        spark,
        {
            "no such algorithm": lambda: text_keys.key_column(F.col("p_brand"), "none/1"),
            "other algorithm deployed": lambda: store.session(replace(unit, derived=(Derived("brand_key", "p_brand", text_keys.UTF16),))),
            "deployed": lambda: store.session(unit) and None,
        },
    )


@query(values(("uuid of version 7, in order", "ok"), ("snowflakes, in order", "ok"), ("base 62, there and back", "ok"), ("short ids", "ok"), ("canonical JSON", '{"a":[1,2],"b":{"x":null,"y":"é"}}')))
def identity_generators(spark, sf_dir):
    ok = lambda x: lambda: "ok" if x else "wrong"
    make, flakes = identity.UuidV7(), identity.Snowflake(3)
    ids, numbers = [make() for _ in range(1000)], [flakes() for _ in range(5000)]
    return cases(
        spark,
        {
            "uuid of version 7, in order": ok(ids == sorted(set(ids)) and all(uuid.UUID(i).version == 7 for i in ids)),
            "snowflakes, in order": ok(numbers == sorted(set(numbers))),
            "base 62, there and back": ok(all(identity.from_base62(identity.base62(n, 8)) == n for n in (0, 61, 62, 10**12))),
            "short ids": ok(all(len(identity.short_id(n)) == n for n in (1, 12))),
            "canonical JSON": lambda: identity.canonical_json('{"b": {"y": "é", "x": null}, "a": [1, 2]}'),
        },
    )


# writes


@query("SELECT c_custkey, CASE WHEN c_custkey = 7 THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment, CASE WHEN c_custkey = 7 THEN 2 ELSE 1 END::bigint AS version FROM customer")
def update_row(spark, sf_dir):
    """Columns that are not given stay."""
    _, s = _filled(spark, sf_dir, CUSTOMER)
    s.update({"c_custkey": 7, "c_name": "renamed"})
    return s.df().select("c_custkey", "c_name", "c_mktsegment", F.col("__quern_version").alias("version"))


@query(
    values(
        ("create a taken key", "VersionConflict"), ("upsert at a wrong version", "VersionConflict"), ("upsert at its version", "Updated"), ("upsert nothing at a version", "NotFound"), ("update nothing", "NotFound"),
        ("insert a taken key", "UniqueViolation"), ("create a new key", "Inserted"), ("delete at a wrong version", "VersionConflict"), ("delete at its version", "Deleted"), ("both conditions", "QN-WRITE-003"), ("null in the key", "QN-WRITE-001"),
    )
)
def conditional_writes(spark, sf_dir):
    _, s = _filled(spark, sf_dir, CUSTOMER)
    row = lambda k, **more: {"c_custkey": k, "c_name": "x", **more}
    return cases(
        spark,
        {
            "create a taken key": lambda: s.upsert(row(1), create_only=True),
            "upsert at a wrong version": lambda: s.upsert(row(1), if_version=9),
            "upsert at its version": lambda: s.upsert(row(1), if_version=1),
            "upsert nothing at a version": lambda: s.upsert(row(-1), if_version=1),
            "update nothing": lambda: s.update(row(-1)),
            "insert a taken key": lambda: s.insert(row(1)),
            "create a new key": lambda: s.upsert(row(-2), create_only=True),
            "delete at a wrong version": lambda: s.delete(9, c_custkey=2),
            "delete at its version": lambda: s.delete(1, c_custkey=2),
            "both conditions": lambda: s.upsert(row(3), 1, True),
            "null in the key": lambda: s.insert({"c_custkey": None}),
        },
    )


_NAMED = unit_like(CUSTOMER, "named", indexes=(Index("one_name", (IndexColumn("c_name"),), unique=True, excludes_missing=True),))


@query("SELECT 'QN-WRITE-002' AS told, count(*) AS total, count(c_name) AS named FROM (SELECT c_custkey, c_name FROM customer UNION ALL SELECT -1, NULL UNION ALL SELECT -2, NULL)")
def unique_index(spark, sf_dir):
    """A taken name is refused and nothing is written; rows without a name are not held against each other."""
    _, s = filled(spark, sf_dir, _NAMED, CUSTOMER)
    name = load(spark, sf_dir, CUSTOMER).agg(F.min("c_name")).first()[0]
    code = told(lambda: s.insert({"c_custkey": -9, "c_name": name}))
    s.insert({"c_custkey": -1}), s.insert({"c_custkey": -2})
    return s.df().agg(F.lit(code).alias("told"), F.count(F.lit(1)).alias("total"), F.count("c_name").alias("named"))


@query("SELECT * FROM (VALUES (0, 'Superseded:2'), (1, 'Updated'), (2, 'Updated'), (3, 'Inserted'), (4, 'Deleted')) t(place, told)")
def exact_outcomes(spark, sf_dir):
    """An outcome for every staged write, the superseded ones too."""
    store, s = _filled(spark, sf_dir, CUSTOMER)
    work = store.unit_of_work(CUSTOMER, exact=True)
    for w in (Write("upsert", {"c_custkey": 1, "c_name": "a"}), Write("update", {"c_custkey": 2, "c_name": "b"}), Write("upsert", {"c_custkey": 1, "c_name": "c"}), Write("insert", {"c_custkey": -1, "c_name": "d"}), Write("delete", {"c_custkey": 3})):
        work.stage(w)
    return spark.createDataFrame(list(enumerate(work.commit()["outcomes"])), "place int, told string")


@query(
    "SELECT * FROM (VALUES ('commit', 'failed: NotFound,UniqueViolation'), ('stage after it', 'QN-BATCH-001'), ('the same write twice', 'QN-BATCH-002')) t(what, told) UNION ALL SELECT 'rows', count(*)::varchar FROM customer"
)
def failed_batch(spark, sf_dir):
    """All failed writes are told, none is committed, and the unit of work takes no more."""
    store, s = _filled(spark, sf_dir, CUSTOMER)
    work, other, w = store.unit_of_work(CUSTOMER), store.unit_of_work(CUSTOMER), Write("upsert", {"c_custkey": 1, "c_name": "a"})
    for x in (Write("upsert", {"c_custkey": -1, "c_name": "new"}), Write("insert", {"c_custkey": 1}), Write("update", {"c_custkey": -5, "c_name": "x"})):
        work.stage(x)
    other.stage(w)
    return cases(spark, {"commit": work.commit, "stage after it": lambda: work.stage(w), "the same write twice": lambda: other.stage(w), "rows": lambda: str(s.df().count())})


@query(
    "SELECT 'customer' AS unit, c_custkey AS id FROM customer UNION ALL SELECT 'customer', -1 UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'nation', -1"
)
def units_together(spark, sf_dir):
    """One unit of work over two units: what succeeds counts in both, what fails in one counts in neither."""
    store, customers = _filled(spark, sf_dir, CUSTOMER)
    store.create(NATION)
    nations = store.session(NATION)
    nations.insert_all(load(spark, sf_dir, NATION))
    work, failing = store.unit_of_work([CUSTOMER, NATION]), store.unit_of_work([CUSTOMER, NATION])
    for w in (Write("insert", {"c_custkey": -1, "c_name": "new"}), Write("insert", {"n_nationkey": -1, "n_name": "new"}, unit="nation"), Write("delete", {"n_nationkey": 3}, unit="nation")):
        work.stage(w)
    work.commit()
    for w in (Write("insert", {"c_custkey": -2, "c_name": "lost"}), Write("update", {"n_nationkey": -9, "n_name": "none"}, unit="nation")):
        failing.stage(w)
    told(failing.commit)
    return customers.df().select(F.lit("customer").alias("unit"), F.col("c_custkey").cast("long").alias("id")).unionAll(nations.df().select(F.lit("nation"), F.col("n_nationkey").cast("long")))


@query("SELECT * FROM (VALUES ('flushed before the commit', 4), ('held by the driver', 1), ('seen by others', 0), ('applied', 4), ('superseded', 1), ('new rows', 4)) t(what, n)")
def flush_at_cap(spark, sf_dir):
    """Five writes under a cap of two: two flushes, and one write is left for the commit; nobody sees any before it."""
    store, s = _filled(spark, sf_dir, CUSTOMER)
    work, new = store.unit_of_work(CUSTOMER, max_rows=2), F.col("c_custkey") < 0
    for k, name in ((-1, "a"), (-1, "b"), (-2, "c"), (-3, "d"), (-4, "e")):
        work.stage(Write("upsert", {"c_custkey": k, "c_name": name}))
    found = {"flushed before the commit": work.total - len(work.staged), "held by the driver": len(work.staged), "seen by others": s.df().where(new).count()}
    out = work.commit()
    found |= {"applied": out["applied"], "superseded": out["superseded"], "new rows": s.df().where(new).count()}
    return spark.createDataFrame(list(found.items()), "what string, n int")


@query("SELECT * FROM (VALUES ('appends', 1), ('batches', 2)) t(what, n)")
def write_observer(spark, sf_dir):
    """Commands that the store ran: one append, and one batch for each of two upserts, whatever their rows."""
    store, s = _filled(spark, sf_dir, CUSTOMER)
    some = load(spark, sf_dir, CUSTOMER).where("c_nationkey < 5").select("c_custkey", "c_name")
    s.upsert_all(some), s.upsert_all(some)
    return spark.createDataFrame(sorted(store.commands.items()), "what string, n int")


_OPS = unit_like(CUSTOMER, "operations", append_window_s=600)


@query(
    "SELECT * FROM (VALUES ('first', 'Inserted'), ('again', 'Replayed'), ('exactly', 'ok'), ('again, exactly', 'ok'), ('other rows, exactly', 'QN-APPEND-001'), ('no operation id', 'QN-APPEND-004'), ('a key twice', 'QN-APPEND-006'), ('a taken key', 'failed: '), ('no rows', 'QN-APPEND-005')) t(what, told) "
    "UNION ALL SELECT 'rows', count(*)::varchar FROM customer"
)
def exact_append(spark, sf_dir):
    """A frame's operation id is bound to its rows."""
    store = _store(spark)
    store.create(_OPS)
    s = store.session(_OPS)
    every = load(spark, sf_dir, CUSTOMER).select(*(x.name for x in CUSTOMER.columns))
    first, again = every.where("c_nationkey < 10"), every.where("c_nationkey >= 10")
    out = cases(
        spark,
        {
            "first": lambda: s.append("one", first),
            "again": lambda: s.append("one", first),
            "exactly": lambda: s.append_rows(again, "two", True) and None,
            "again, exactly": lambda: s.append_rows(again, "two", True) and None,
            "other rows, exactly": lambda: s.append_rows(first, "two", True),
            "no operation id": lambda: s.append("", first),
            "a key twice": lambda: s.append("three", [{"c_custkey": -1}, {"c_custkey": -1}]),
            "a taken key": lambda: s.append("four", first.limit(1)),
            "no rows": lambda: s.append("five", []),
        },
    )
    return out.unionAll(s.df().agg(F.lit("rows").alias("what"), F.count(F.lit(1)).cast("string").alias("told")))


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 2")
def retention_on_append(spark, sf_dir):
    _, s = filled(spark, sf_dir, unit_like(EVENTS, "kept", retention=Retention(2, "ts", ("user_id",), on_append=True)), EVENTS)
    return s.df().select("event_id", "user_id")


@query("SELECT sum(greatest(n - 4, 0))::bigint AS deleted, sum(greatest(n - 4, 0))::bigint AS replayed, sum(least(n, 4))::bigint AS held, sum(n)::bigint AS high_water, 'QN-APPEND-001' AS told FROM (SELECT count(*) AS n FROM events GROUP BY user_id)")
def exact_retention(spark, sf_dir):
    """A pass with an operation id runs once; what was committed ever is kept beside the rows."""
    unit = Unit("sequenced", (col("seq", Kind.INT64, False, generated="sequence"), col("user_id", Kind.INT64, False)), ("seq",), retention=Retention(4, "seq", ("user_id",)))
    store = _store(spark)
    store.create(unit)
    s = store.session(unit)
    s.append_rows(load(spark, sf_dir, EVENTS).select("user_id"))
    first, again = s.apply_retention(operation="nightly"), s.apply_retention(operation="nightly")
    code = told(lambda: s.apply_retention(1, operation="nightly"))
    return s.df().agg(F.lit(first["deleted"]).cast("long").alias("deleted"), F.lit(again["deleted"]).cast("long").alias("replayed"), F.count(F.lit(1)).alias("held"), F.lit(s.inspect()["high_water"]).cast("long").alias("high_water"), F.lit(code).alias("told"))


@query("SELECT count(*) AS deleted, (SELECT count(*) FROM events) - count(*) AS held, true AS stopped FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r > 3")
def resumed_retention(spark, sf_dir):
    """A pass that is stopped after its first commit leaves whole buckets done; the next one does the rest."""
    _, s = _filled(spark, sf_dir, EVENTS)
    stops = iter([False, True])
    first = s.apply_retention(max_rows_per_batch=1, stop=lambda: next(stops, True))
    second = s.apply_retention()
    return s.df().agg(F.lit(first["deleted"] + second["deleted"]).cast("long").alias("deleted"), F.count(F.lit(1)).alias("held"), F.lit(first["stopped"]).alias("stopped"))


# records and documents


@dataclasses.dataclass
class CustomerRecord:
    c_custkey: int
    c_name: str | None
    c_mktsegment: str | None


@dataclasses.dataclass
class CustomerName:
    c_name: str | None


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey IN (5, 6, 7) OR c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING')")
def record_rows(spark, sf_dir):
    """Typed rows by key, by query, and a smaller record of them."""
    unit = unit_of(CustomerRecord, "records", ("c_custkey",))
    store, s = filled(spark, sf_dir, unit, CUSTOMER)
    table = RecordTable(CustomerRecord, s)
    q = table.query()
    found = [table.get(c_custkey=k) for k in (5, 6, 7)] + table.records(q.where(q.row.c_mktsegment == "BUILDING").order_by("c_custkey").take(1))
    names = table.project(CustomerName, q.where(q.row.c_custkey.isin([5, 6, 7])).take(5))
    assert sorted(n.c_name for n in names) == sorted(r.c_name for r in found[:3])
    held = {r.c_custkey: (r.c_custkey, r.c_name, r.c_mktsegment) for r in found}
    return spark.createDataFrame(list(held.values()), "c_custkey long, c_name string, c_mktsegment string")


def _renamed(body: dict) -> dict:
    return {"head": {"name": body["name"]}, "region": body["region"]}


@query("SELECT n_nationkey::varchar AS id, '{\"head\":{\"name\":\"' || n_name || '\"},\"region\":' || n_regionkey || '}' AS body, 2 AS schema_version, n_regionkey::bigint AS region FROM nation WHERE n_nationkey <> 3")
def document_bodies(spark, sf_dir):
    """Bodies of an older version read as the newest; one document saved anew, one deleted."""
    old = DocumentUnit("bodies", (Projection(col("region", Kind.INT64), "region"),))
    store = _store(spark)
    store.create(old.unit())
    first = Documents(old, store.session(old.unit()))
    held = load(spark, sf_dir, NATION).collect()  # a table of fixed size
    first.session.append_rows([first._row(str(r.n_nationkey), {"region": r.n_regionkey, "name": r.n_name}) for r in held])
    new = replace(old, version=2, upcasters={1: _renamed})
    docs = Documents(new, store.session(new.unit()))
    docs.save("4", docs.get("4"))
    docs.delete("3")
    return docs.upcast(docs.query().to_df()).select("id", "body", "schema_version", "region")


# evolution and admission


@query(values(("column gone", "QN-SCHEMA-001"), ("column changed", "QN-SCHEMA-002"), ("no default", "QN-SCHEMA-003"), ("key changed", "QN-SCHEMA-002,QN-SCHEMA-004"), ("same again", "")))
def schema_refusals(spark, sf_dir):
    now = Unit("part", (col("p_partkey", Kind.INT64, False), col("p_brand", Kind.STRING), col("p_size", Kind.INT32)), ("p_partkey",))
    worse = {
        "column gone": replace(now, columns=now.columns[:2]),
        "column changed": replace(now, columns=(*now.columns[:2], col("p_size", Kind.INT64))),
        "no default": replace(now, columns=(*now.columns, col("note", Kind.STRING, False))),
        "key changed": replace(now, columns=(now.columns[0], col("p_brand", Kind.STRING, False), now.columns[2]), key=("p_partkey", "p_brand")),
        "same again": now,
    }
    return cases(spark, {k: lambda u=u: ",".join(sorted({r.code for r in schema.plan(now, u).refusals})) for k, u in worse.items()})


@query(values(("changed column", "QN-RUNTIME-001"), ("layout not deployed", "QN-RUNTIME-002"), ("as deployed", "ok"), ("no such unit", "QN-RUNTIME-003"), ("files as declared", "ok"), ("files without a column", "QN-RUNTIME-004")))
def admission(spark, sf_dir):
    """Deployed against declared, and the files against both."""
    store, _ = filled(spark, sf_dir, NATION, NATION)
    turned = replace(NATION, indexes=(Index("by_name", (IndexColumn("n_name"),)),))
    wide = replace(NATION, columns=(*NATION.columns, col("n_extra", Kind.STRING)))
    return cases(
        spark,
        {
            "changed column": lambda: store.admit(replace(NATION, columns=(*NATION.columns[:2], col("n_regionkey", Kind.STRING)))),
            "layout not deployed": lambda: store.admit(turned)[0].code,
            "as deployed": lambda: store.admit(NATION) or None,
            "no such unit": lambda: store.session(replace(NATION, name="nothing")),
            "files as declared": lambda: next((r.code for r in store.inspect_files(NATION)), "ok"),
            "files without a column": lambda: next((r.code for r in store.inspect_files(wide)), "ok"),
        },
    )


@query("SELECT * FROM (VALUES ('QN-PORT-001'), ('QN-PORT-002'), ('QN-PORT-003'), ('QN-PORT-005'), ('QN-PORT-006'), ('QN-PORT-007'), ('QN-PORT-008'), ('QN-PORT-009'), ('QN-PORT-010'), ('QN-PORT-011')) t(told)")
def portability_codes(spark, sf_dir):
    bad = Unit(
        "u",
        (col("a", Kind.INT64), col("a", Kind.STRING), col("__quern_x", Kind.STRING), col("d", Kind.DOUBLE), col("s", Kind.INT32, generated="sequence"), col("e", Kind.INT32, default="x"), col("big", Kind.DECIMAL, precision=40)),
        ("a", "b"),
        (Index("i", (IndexColumn("nope"),)),),
        derived=(Derived("k", "nope", "x"),),
        retention=Retention(-1, "nope", ()),
    )
    return spark.createDataFrame(sorted({(r.code,) for r in validate_unit(bad)}), "told string")


@query("SELECT * FROM (VALUES (0, ''), (1, ''), (2, 'QN-COVER-006'), (3, 'QN-COVER-005')) t(place, told)")
def verified_inventory(spark, sf_dir):
    """A list of query shapes against the declared layouts, as the build does it."""
    shapes = [{"equal": ["o_orderstatus"]}, {"equal": ["o_orderstatus"], "range": ["o_orderdate"]}, {"equal": ["o_custkey"]}, {"total_count": True}]
    return spark.createDataFrame([(i, ",".join(r.code for r in schema.verify(ORDERS, [s]))) for i, s in enumerate(shapes)], "place int, told string")


# coverage

_TODAY = dt.date(2024, 1, 1)


@query(
    values(
        ("equality", "ix_status"), ("equality and range", "ix_status"), ("range of the second column", "QN-COVER-006"), ("no bound", "QN-COVER-005"), ("substring", "QN-COVER-016"), ("nothing can match", "covered"),
        ("accepted scan", "QN-COVER-905"), ("expired acceptance", "QN-COVER-903"), ("acceptance not needed", "QN-COVER-901"), ("suggestion", "o_custkey,o_totalprice"),
    )
)
def coverage_cases(spark, sf_dir):
    def check(p, **more) -> str:
        found = coverage.check(Query(ORDERS, p, **more), today=_TODAY)
        if found.warnings:
            return found.warnings[-1].code
        return (found.index.name if found.index else "covered") if found.covered else found.refusals[0].code

    late = between(c["o_orderdate"], dt.datetime(1997, 1, 1, tzinfo=UTC))
    scan = lambda d: Scan("S-1", "monthly report", "sales", d)
    free = Substring(c["o_orderpriority"], "H")
    return cases(
        spark,
        {
            "equality": lambda: check(eq(c["o_orderstatus"], "F")),
            "equality and range": lambda: check(And((eq(c["o_orderstatus"], "F"), late))),
            "range of the second column": lambda: check(late),
            "no bound": lambda: check(And(())),
            "substring": lambda: check(free),
            "nothing can match": lambda: check(FALSE),
            "accepted scan": lambda: check(free, accepted_scan=scan(dt.date(2025, 1, 1))),
            "expired acceptance": lambda: check(free, accepted_scan=scan(_TODAY)),
            "acceptance not needed": lambda: check(eq(c["o_orderstatus"], "F"), accepted_scan=scan(dt.date(2025, 1, 1))),
            "suggestion": lambda: ",".join(x.name for x in coverage.suggest(Query(ORDERS, And((eq(c["o_custkey"], 1), between(c["o_totalprice"], D(1)))))).columns),
        },
    )


@query(values(("covered", "ok"), ("not covered", "QN-COVER-016"), ("shapes held", "1"), ("shapes dropped", "1"), ("values", "QN-FENCE-001"), ("parameters", "QN-FENCE-002"), ("pushed", "ok"), ("not pushed", "QN-EXPLAIN-001")))
def gate_and_fence(spark, sf_dir):
    """Admission at run time with its bounded memory, the budgets of values, and plans that are asserted."""
    df = load(spark, sf_dir, ORDERS)
    gate = coverage.Gate(ORDERS.indexes, limit=1)
    many = lambda n: among(c["o_custkey"], list(range(n)))
    either = Or(tuple(And((many(600), eq(c["o_orderkey"], i))) for i in range(4)))
    q = Query(ORDERS, eq(c["o_orderstatus"], "F"))
    return cases(
        spark,
        {
            "covered": lambda: gate.admit(q) and None,
            "not covered": lambda: gate.admit(Query(ORDERS, Substring(c["o_orderpriority"], "H"))),
            "shapes held": lambda: str(len(gate.seen)),
            "shapes dropped": lambda: str(gate.evicted),
            "values": lambda: coverage.fence(Query(ORDERS, many(1001)), Access()),
            "parameters": lambda: coverage.fence(Query(ORDERS, either), Access()),
            "pushed": lambda: coverage.assert_plan(plans.plan(df, q), "EqualTo(o_orderstatus,F)"),
            "not pushed": lambda: coverage.assert_plan(plans.plan(df, q), "EqualTo(o_orderkey"),
        },
    )


# the fluent front end


def recent(row: Rows) -> Predicate:
    """A reusable fragment."""
    return row.o_orderdate >= dt.datetime(1997, 1, 1, tzinfo=UTC)


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderstatus <> 'P' AND cast(o_totalprice AS decimal(18,4)) BETWEEN 1000 AND 200000 ORDER BY o_orderdate DESC, o_custkey, o_orderkey LIMIT 30 OFFSET 10")
def fluent_page(spark, sf_dir):
    t = Table(ORDERS, load(spark, sf_dir, ORDERS))
    t = t.where(recent).where(lambda r: r.o_orderstatus != "P").where_if(True, lambda r: r.o_totalprice.between(D(1000), D(200000))).where_if(False, lambda r: r.o_custkey == 1)
    return shown(t.order_by("o_orderdate", descending=True).then_by("o_custkey").skip(10).take(30).select("o_orderkey", "o_custkey", "o_orderdate").to_df())


@query("SELECT p_partkey, p_type FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#13') AND (starts_with(p_name, 's') OR contains(p_name, 'ring') OR ends_with(p_name, 't')) AND list_has_any(string_split(p_type, ' '), ['ECONOMY', 'SMALL']) AND list_has_all(string_split(p_type, ' '), ['ECONOMY'])")
def fluent_text_and_sets(spark, sf_dir):
    t = Table(PART, load(spark, sf_dir, PART))
    t = t.where(lambda r: r.p_brand.isin(["Brand#1", "Brand#2", "Brand#13"]) & (r.p_name.startswith("s") | r.p_name.contains("ring") | r.p_name.endswith("t")))
    return t.where(lambda r: r.words.any_of(["ECONOMY", "SMALL"]) & r.words.all_of(["ECONOMY"]) & r.words.has_element("ECONOMY")).select("p_partkey", "p_type").to_df()


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (year(l_shipdate) = 1996 OR cast(l_shipdate AS date) = DATE '1997-03-04') AND l_partkey IS NOT NULL AND l_partkey <> l_suppkey")
def fluent_dates(spark, sf_dir):
    """Date parts become ranges; a column is compared with another."""
    t = Table(LINEITEM, load(spark, sf_dir, LINEITEM))
    t = t.where(lambda r: ((r.l_shipdate.year == 1996) | (r.l_shipdate.date == dt.date(1997, 3, 4))) & r.l_partkey.has_value() & (r.l_partkey != r.l_suppkey))
    return t.select("l_orderkey", "l_linenumber").to_df()


@query("SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def fluent_latest(spark, sf_dir):
    t = Table(EVENTS, load(spark, sf_dir, EVENTS)).where(lambda r: ~(r.event_type == "view"))
    return shown(t.latest_per("user_id", "ts").select("event_id", "user_id", "ts").to_df())


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS n, (SELECT count(*) > 0 FROM orders WHERE o_totalprice < 0) AS negative, (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS dearest, 0 AS of_none")
def fluent_terminals(spark, sf_dir):
    t = Table(ORDERS, load(spark, sf_dir, ORDERS))
    f = t.where(t.row.o_orderstatus == "F")
    dearest = f.order_by("o_totalprice", descending=True).take(1).to_list().rows[0]["o_orderkey"]
    return spark.createDataFrame([(f.count(), t.where(t.row.o_totalprice < D(0)).any(), dearest, t.none().count())], "n long, negative boolean, dearest long, of_none int")


@query(
    values(
        ("join", "QN-FLUENT-104"), ("group", "QN-FLUENT-105"), ("function of a column", "QN-FLUENT-101"), ("arithmetic", "QN-FLUENT-102"), ("truth value", "QN-FLUENT-107"), ("time without zone", "QN-FLUENT-109"),
        ("order of a date part", "QN-FLUENT-101"), ("no page", "QN-QUERY-002"), ("scan accepted", "QN-COVER-905"),
    )
)
def fluent_refusals(spark, sf_dir):
    t = Table(ORDERS, load(spark, sf_dir, ORDERS))
    r = t.row
    return cases(
        spark,
        {
            "join": lambda: t.join(t),
            "group": lambda: t.group_by("o_custkey"),
            "function of a column": lambda: r.o_orderpriority.upper(),
            "arithmetic": lambda: r.o_totalprice + 1,
            "truth value": lambda: bool(r.o_orderstatus),
            "time without zone": lambda: r.o_orderdate > dt.datetime(2024, 1, 1),
            "order of a date part": lambda: r.o_orderdate.year > 1996,
            "no page": lambda: t.to_list(),
            "scan accepted": lambda: coverage.check(t.accept_scan("S-1", "report", "sales", dt.date(2025, 1, 1)).query, today=_TODAY).warnings[-1].code,
        },
    )


# streams


def settled(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """A stream run to the end of its input, its result in a folder."""
    folder = work_folder(spark)

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out" if mode == "complete" else f"{folder}/out/{number}")

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2024-01-01') AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_buckets(spark, sf_dir):
    found = streams.bucket_counts(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", dt.timedelta(hours=6), dt.timedelta(minutes=1), ("event_type",))
    return shown(settled(spark, found, "complete"))


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), "
    "s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOURS AS \"end\", count(*) AS n FROM s GROUP BY user_id, k"
)
def stream_sessions(spark, sf_dir):
    found = streams.sessions(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", dt.timedelta(hours=8), dt.timedelta(minutes=1))
    return shown(settled(spark, found, "complete"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def stream_latest(spark, sf_dir):
    found = streams.latest_per_key(event_stream(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), EVENTS, "user_id", "ts")
    return settled(spark, found, "complete").select("event_id", "user_id", "event_type")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(spark, sf_dir):
    stream = event_stream(spark, sf_dir).select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return settled(spark, streams.without_repeats(stream, ["user_id", "event_type"], "ts", dt.timedelta(days=400)), "append").select("user_id", "event_type")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def stream_retention(spark, sf_dir):
    """Events streamed into a unit that keeps the newest three of each user: the state is the unit."""
    unit = unit_like(EVENTS, "streamed_kept", columns=(EVENTS.column("event_id"), EVENTS.column("user_id"), EVENTS.column("ts")), indexes=(), profiles=(), retention=Retention(3, "ts", ("user_id",), on_append=True), append_window_s=3600)
    store = _store(spark)
    store.create(unit)
    stream = event_stream(spark, sf_dir).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    streams.append_stream(store.session(unit), stream, f"{store.root}/checkpoint", "kept").awaitTermination()
    return store.session(unit).df().select("event_id", "user_id")
