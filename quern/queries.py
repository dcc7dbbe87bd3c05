"""Queries of the engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text_keys
from quern.model import SCOPE, Access, Column, Derived, ElementSet, Index, IndexColumn, Kind, Retention, Unit
from quern.operators import aggregate as agg
from quern.operators.aggregate import AggregateQuery, Count, FirstBy, FixedBucket, Having, LocalDay, Max, Min, Profile, SetUnion, Sum
from quern.plans import query as plans
from quern.plans.compile import Order
from quern.plans.query import Latest, Page, Query
from quern.predicates import And, Compare, Not, Or, StartsWith, Substring, among, between, element_of, eq
from quern.session import work_folder
from quern.sources.files import conform, placed
from quern.sources.store import Store, UnitOfWork, Write

UTC = dt.timezone.utc
D = decimal.Decimal


def col(name: str, kind: Kind, nullable: bool = True, **more) -> Column:
    return Column(name, kind, nullable, plain_text=kind is Kind.STRING, **more)


EVENTS = Unit(
    "events",
    (
        col("event_id", Kind.INT64, False),
        col("ts", Kind.TIMESTAMP, False),
        col("user_id", Kind.INT64, False),
        col("event_type", Kind.STRING, False),
        col("value", Kind.DECIMAL),
        col("props", Kind.JSON),
    ),
    ("event_id",),
    indexes=(Index("ix_ts", (IndexColumn("ts", True), IndexColumn("event_id"))), Index("ix_type_ts", (IndexColumn("event_type"), IndexColumn("ts")))),
    profiles=(
        Profile("by-type", ("event_type",), (Count("n"), Min("first_ts", "ts"), Max("last_ts", "ts"), Min("low", "value"), Max("high", "value")), {"n": ("range",), "event_type": ("=", "in")}),
        Profile("by-user", ("user_id",), (Count("n"), SetUnion("types", "event_type", 16), FirstBy("first_type", "event_type", "ts"), FirstBy("last_type", "event_type", "ts", True)), {"types": ("contains",), "n": ("range",)}, 100_000, 10**9),
        Profile("hourly", (FixedBucket("bucket", "ts", dt.timedelta(hours=1)), "event_type"), (Count("n"), Sum("total", "value")), {}, 100_000, 10**9),
        Profile("ninety", (FixedBucket("bucket", "ts", dt.timedelta(minutes=90)),), (Count("n"),), {}, 100_000, 10**9),
        Profile("daily", (LocalDay("day", "ts"),), (Count("n"), Sum("total", "value")), {}, 100_000, 10**9),
    ),
    retention=Retention(3, "ts", ("user_id",)),
)
ORDERS = Unit(
    "orders",
    (
        col("o_orderkey", Kind.INT64, False),
        col("o_custkey", Kind.INT64, False),
        col("o_orderstatus", Kind.STRING),
        col("o_totalprice", Kind.DECIMAL),
        col("o_orderdate", Kind.TIMESTAMP, False),
        col("o_orderpriority", Kind.STRING),
    ),
    ("o_orderkey",),
    indexes=(Index("ix_status", (IndexColumn("o_orderstatus"), IndexColumn("o_orderdate"))),),
)
LINEITEM = Unit(
    "lineitem",
    (
        col("l_orderkey", Kind.INT64, False),
        col("l_linenumber", Kind.INT32, False),
        col("l_partkey", Kind.INT64),
        col("l_suppkey", Kind.INT64),
        col("l_quantity", Kind.DECIMAL),
        col("l_extendedprice", Kind.DECIMAL),
        col("l_discount", Kind.DECIMAL),
        col("l_tax", Kind.DECIMAL),
        col("l_returnflag", Kind.STRING),
        col("l_linestatus", Kind.STRING),
        col("l_shipdate", Kind.TIMESTAMP),
    ),
    ("l_orderkey", "l_linenumber"),
    profiles=(
        Profile(
            "by-flag",
            ("l_returnflag", "l_linestatus"),
            (Count("n"), Sum("sum_qty", "l_quantity"), Sum("sum_price", "l_extendedprice"), Sum("sum_lines", "l_linenumber"), Min("min_ship", "l_shipdate"), Max("max_ship", "l_shipdate")),
            {"n": ("range",), "l_returnflag": ("=", "in")},
            1000,
            10**9,
        ),
        Profile("by-supplier", ("l_suppkey",), (Count("n"), Sum("sum_qty", "l_quantity"), Max("max_price", "l_extendedprice")), {"n": ("range",), "sum_qty": ("range",)}, 100_000, 10**9),
        Profile("by-part", ("l_partkey",), (FirstBy("last_flag", "l_returnflag", "l_orderkey", True), FirstBy("first_flag", "l_returnflag", "l_orderkey")), {}, 100_000, 10**9),
    ),
)
CUSTOMER = Unit(
    "customer",
    (col("c_custkey", Kind.INT64, False), col("c_name", Kind.STRING), col("c_nationkey", Kind.INT32), col("c_acctbal", Kind.DECIMAL), col("c_mktsegment", Kind.STRING)),
    ("c_custkey",),
    versioned=True,
)
SCOPED_CUSTOMER = Unit("scoped_customer", CUSTOMER.columns, ("c_custkey",), scoped=True)
PART = Unit(
    "part",
    (col("p_partkey", Kind.INT64, False), col("p_name", Kind.STRING), col("p_brand", Kind.STRING), col("p_type", Kind.STRING), col("p_size", Kind.INT32), col("p_retailprice", Kind.DECIMAL)),
    ("p_partkey",),
    element_sets=(ElementSet("words", Kind.STRING),),
)


def load(spark: SparkSession, sf_dir: str, unit: Unit, place: bool = False) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{unit.name.removeprefix('scoped_')}.parquet")
    if place:
        df = placed(df)
    if unit is PART:
        df = df.withColumn("words", F.split("p_type", " "))
    if unit is SCOPED_CUSTOMER:
        df = df.withColumn(SCOPE, F.col("c_mktsegment"))
    return conform(df, unit)


def shown(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times without zone, for comparison with other engines."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        out.append((c.cast("double") if kind.startswith("decimal") else c.cast("timestamp_ntz") if kind == "timestamp" else F.array_join(c, "|") if kind.startswith("array") else c).alias(f.name))
    return df.select(*out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def rows(spark: SparkSession, sf_dir: str, q: Query, access: Access = Access()) -> DataFrame:
    return shown(plans.plan(load(spark, sf_dir, q.unit), q, access))


c = {n: u.column(n) for u in (EVENTS, ORDERS, LINEITEM, CUSTOMER, PART) for n in [x.name for x in u.columns]}
O_COLS = ("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
_O = "o_orderkey, o_orderstatus, cast(o_totalprice as double) AS o_totalprice, o_orderdate"

# predicates


@query(f"SELECT {_O} FROM orders WHERE o_orderstatus = 'F'")
def eq_(spark, sf_dir):
    return rows(spark, sf_dir, Query(ORDERS, eq(c["o_orderstatus"], "F"), columns=O_COLS))


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders) WHERE o_orderpriority IS DISTINCT FROM '5-LOW'")
def not_eq_total(spark, sf_dir):
    df = load(spark, sf_dir, ORDERS).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return shown(plans.plan(df, Query(ORDERS, Not(eq(c["o_orderpriority"], "5-LOW")), columns=("o_orderkey", "o_orderpriority"))))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE p IS NULL")
def eq_null(spark, sf_dir):
    df = load(spark, sf_dir, ORDERS).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return shown(plans.plan(df, Query(ORDERS, eq(c["o_orderpriority"], None), columns=("o_orderkey",))))


@query(f"SELECT {_O} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(spark, sf_dir):
    return rows(spark, sf_dir, Query(ORDERS, among(c["o_orderpriority"], ["1-URGENT", "2-HIGH"]), columns=O_COLS))


@query("SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders) WHERE o_orderpriority IS NULL OR o_orderpriority = '2-HIGH'")
def in_with_null(spark, sf_dir):
    df = load(spark, sf_dir, ORDERS).withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    return shown(plans.plan(df, Query(ORDERS, among(c["o_orderpriority"], ["2-HIGH", None]), columns=("o_orderkey", "o_orderpriority"))))


@query("SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-02-01' AND event_type IN ('click', 'view', 'purchase')")
def range_incl_excl(spark, sf_dir):
    p = And((between(c["ts"], dt.datetime(2024, 1, 5, tzinfo=UTC), dt.datetime(2024, 2, 1, tzinfo=UTC), True, False), among(c["event_type"], ["click", "view", "purchase"])))
    return rows(spark, sf_dir, Query(EVENTS, p, columns=("event_id", "user_id", "event_type")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE cast(l_quantity AS decimal(18,4)) > 10 AND cast(l_quantity AS decimal(18,4)) <= 20 AND cast(l_discount AS decimal(18,4)) >= 0.05")
def range_decimal(spark, sf_dir):
    p = And((between(c["l_quantity"], D(10), D(20), False), between(c["l_discount"], D("0.05"))))
    return rows(spark, sf_dir, Query(LINEITEM, p, columns=("l_orderkey", "l_linenumber")))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_brand, 'Brand#1')")
def starts_with(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, StartsWith(c["p_brand"], "Brand#1"), columns=("p_partkey", "p_name")))


@query("SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'A')")
def contains(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, Substring(c["p_type"], "A"), columns=("p_partkey", "p_type")))


@query("SELECT p_partkey, p_type FROM part WHERE ends_with(p_type, 'L')")
def ends_with(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, Substring(c["p_type"], "L", True), columns=("p_partkey", "p_type")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey < l_suppkey")
def column_compare(spark, sf_dir):
    return rows(spark, sf_dir, Query(LINEITEM, Compare(c["l_partkey"], "<", c["l_suppkey"]), columns=("l_orderkey", "l_linenumber")))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, nullif(l_partkey % 7, 0) AS a, nullif(l_suppkey % 7, 1) AS b FROM lineitem) WHERE NOT coalesce(a <> b, false)")
def column_compare_not(spark, sf_dir):
    df = load(spark, sf_dir, LINEITEM).withColumns({"l_partkey": F.nullif(F.col("l_partkey") % 7, F.lit(0)), "l_suppkey": F.nullif(F.col("l_suppkey") % 7, F.lit(1))})
    return shown(plans.plan(df, Query(LINEITEM, Not(Compare(c["l_partkey"], "<>", c["l_suppkey"])), columns=("l_orderkey", "l_linenumber"))))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag = 'R' OR l_returnflag = 'A') AND NOT (l_linestatus = 'O' OR l_linenumber = 1)")
def and_or_not(spark, sf_dir):
    p = And((Or((eq(c["l_returnflag"], "R"), eq(c["l_returnflag"], "A"))), Not(Or((eq(c["l_linestatus"], "O"), eq(c["l_linenumber"], 1))))))
    return rows(spark, sf_dir, Query(LINEITEM, p, columns=("l_orderkey", "l_linenumber")))


@query("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['SMALL', 'ECONOMY', 'PROMO'])")
def element_of_any(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, element_of(PART.element_set("words"), ["SMALL", "ECONOMY", "PROMO"]), columns=("p_partkey",)))


@query("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), ['PROMO'])")
def element_of_all(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, element_of(PART.element_set("words"), ["PROMO"], True), columns=("p_partkey",)))


@query("SELECT p_partkey FROM part WHERE NOT list_has_any(string_split(p_type, ' '), ['PROMO'])")
def element_of_not(spark, sf_dir):
    return rows(spark, sf_dir, Query(PART, Not(element_of(PART.element_set("words"), ["PROMO"])), columns=("p_partkey",)))


@query("SELECT o_orderkey FROM orders WHERE false")
def contradiction(spark, sf_dir):
    return rows(spark, sf_dir, Query(ORDERS, And((eq(c["o_orderstatus"], "F"), eq(c["o_orderstatus"], "O"))), columns=("o_orderkey",)))


# order, pages, counts

_BY = (Order(c["o_orderstatus"]), Order(c["o_orderdate"], True, False))
_SQL_BY = "ORDER BY o_orderstatus ASC NULLS FIRST, o_orderdate DESC NULLS LAST, o_orderkey ASC NULLS FIRST"


@query(f"SELECT {_O} FROM orders {_SQL_BY} LIMIT 50")
def order_tie_break(spark, sf_dir):
    return rows(spark, sf_dir, Query(ORDERS, order=_BY, columns=O_COLS, page=Page(50)))


@query(f"SELECT {_O} FROM orders {_SQL_BY} LIMIT 40 OFFSET 100")
def offset_limit(spark, sf_dir):
    return rows(spark, sf_dir, Query(ORDERS, order=_BY, columns=O_COLS, page=Page(40, 100)))


@query("SELECT event_id, ts, event_type FROM events WHERE event_type IN ('click', 'view', 'purchase') ORDER BY ts DESC, event_id LIMIT 20 OFFSET 20")
def keyset_page2(spark, sf_dir):
    """The second page of a keyset query, by the token of the first."""
    df = load(spark, sf_dir, EVENTS)
    q = Query(EVENTS, among(c["event_type"], ["click", "view", "purchase"]), (Order(c["ts"], True, False),), ("event_id", "ts", "event_type"), Page(20, keyset=True))
    token = plans.run(df, q).next_token
    if token is None:
        return shown(df.select("event_id", "ts", "event_type").limit(0))
    second = plans.run(df, Query(q.unit, q.where, q.order, q.columns, Page(20, 0, True, token)))
    return shown(spark.createDataFrame(second.rows, df.select("event_id", "ts", "event_type").schema))


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O'")
def total_count(spark, sf_dir):
    return plans.base_plan(load(spark, sf_dir, ORDERS), Query(ORDERS, eq(c["o_orderstatus"], "O"), total_count=True)).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT count(*) > 0 AS found FROM orders WHERE o_orderstatus = 'P'")
def any_(spark, sf_dir):
    return plans.base_plan(load(spark, sf_dir, ORDERS), Query(ORDERS, eq(c["o_orderstatus"], "P"))).limit(1).agg((F.count(F.lit(1)) > 0).alias("found"))


@query("SELECT event_id, user_id, ts, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_per_key(spark, sf_dir):
    return rows(spark, sf_dir, Query(EVENTS, latest=Latest(c["user_id"], c["ts"]), columns=("event_id", "user_id", "ts", "event_type")))


@query("SELECT event_id, user_id, ts FROM (SELECT * FROM events WHERE event_type = 'click') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def latest_of_filtered(spark, sf_dir):
    return rows(spark, sf_dir, Query(EVENTS, eq(c["event_type"], "click"), latest=Latest(c["user_id"], c["ts"]), columns=("event_id", "user_id", "ts")))


@query("SELECT c_custkey, c_mktsegment AS scope, upper(sha256(c_mktsegment)) AS token FROM customer WHERE c_nationkey = 3")
def cross_scope(spark, sf_dir):
    q = Query(SCOPED_CUSTOMER, eq(SCOPED_CUSTOMER.column("c_nationkey"), 3), columns=("c_custkey",))
    found = plans.plan(load(spark, sf_dir, SCOPED_CUSTOMER), q, Access.across("auditor", "yearly review"))
    return found.select("c_custkey", F.col(SCOPE).alias("scope"), plans.scope_token().alias("token"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def scoped_query(spark, sf_dir):
    q = Query(SCOPED_CUSTOMER, between(SCOPED_CUSTOMER.column("c_nationkey"), None, 10, True, False), columns=("c_custkey", "c_name"))
    return rows(spark, sf_dir, q, Access.to("BUILDING"))


# aggregation


def reduced(spark: SparkSession, sf_dir: str, unit: Unit, q: AggregateQuery) -> DataFrame:
    return shown(agg.plan(load(spark, sf_dir, unit, place=True), unit, unit.profile(q.profile), q))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, cast(min(cast(value AS decimal(18,4))) AS double) AS low, cast(max(cast(value AS decimal(18,4))) AS double) AS high FROM events GROUP BY event_type")
def agg_count_min_max(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("by-type"))


_FLAG = "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(cast(l_quantity AS decimal(18,4))) AS double) AS sum_qty, cast(sum(cast(l_extendedprice AS decimal(18,4))) AS double) AS sum_price, cast(sum(l_linenumber) AS bigint) AS sum_lines, min(l_shipdate) AS min_ship, max(l_shipdate) AS max_ship FROM lineitem"


@query(f"{_FLAG} GROUP BY ALL")
def agg_sum_decimal(spark, sf_dir):
    return reduced(spark, sf_dir, LINEITEM, AggregateQuery("by-flag"))


@query(f"{_FLAG} WHERE cast(l_discount AS decimal(18,4)) >= 0.03 GROUP BY ALL")
def agg_source_filter(spark, sf_dir):
    return reduced(spark, sf_dir, LINEITEM, AggregateQuery("by-flag", between(c["l_discount"], D("0.03"))))


@query("SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, -event_id)) AS last_type FROM events GROUP BY user_id")
def agg_set_union_first_by(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("by-user"))


@query("SELECT l_partkey, arg_max(l_returnflag, (l_orderkey, -l_linenumber)) AS last_flag, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS first_flag FROM lineitem GROUP BY l_partkey")
def agg_first_by(spark, sf_dir):
    return reduced(spark, sf_dir, LINEITEM, AggregateQuery("by-part"))


_SUPP = "SELECT l_suppkey, count(*) AS n, cast(sum(cast(l_quantity AS decimal(18,4))) AS double) AS sum_qty, cast(max(cast(l_extendedprice AS decimal(18,4))) AS double) AS max_price FROM lineitem GROUP BY l_suppkey"


@query(f"{_SUPP} HAVING count(*) BETWEEN 550 AND 620")
def agg_having(spark, sf_dir):
    return reduced(spark, sf_dir, LINEITEM, AggregateQuery("by-supplier", having=(Having("n", "range", (550, 620)),)))


@query("SELECT user_id, count(*) AS n, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS types, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, -event_id)) AS last_type FROM events GROUP BY user_id HAVING bool_or(event_type = 'purchase')")
def agg_having_contains(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("by-user", having=(Having("types", "contains", ("purchase",)),)))


@query(f"{_SUPP} ORDER BY n DESC NULLS LAST, l_suppkey ASC NULLS FIRST LIMIT 25")
def agg_order_take(spark, sf_dir):
    return reduced(spark, sf_dir, LINEITEM, AggregateQuery("by-supplier", order=(("n", True),), take=25))


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, cast(sum(cast(value AS decimal(18,4))) AS double) AS total FROM events GROUP BY ALL")
def bucket_fixed_hour(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("hourly"))


@query("SELECT time_bucket(INTERVAL 90 MINUTES, ts, TIMESTAMP '2024-01-01 00:17:00') AS bucket, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-03-01' GROUP BY ALL")
def bucket_fixed_origin(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("ninety", time_from=dt.datetime(2024, 1, 10, tzinfo=UTC), time_to=dt.datetime(2024, 3, 1, tzinfo=UTC), origin=dt.datetime(2024, 1, 1, 0, 17, tzinfo=UTC)))


@query("SELECT date_trunc('day', ts + INTERVAL 330 MINUTES) - INTERVAL 330 MINUTES AS day, count(*) AS n, cast(sum(cast(value AS decimal(18,4))) AS double) AS total FROM events GROUP BY ALL")
def bucket_local_day(spark, sf_dir):
    return reduced(spark, sf_dir, EVENTS, AggregateQuery("daily", zone="Asia/Kolkata"))


# text keys


@query("SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded, regexp_replace(hex(p_brand), '(..)', '00\\1', 'g') AS units FROM part")
def text_search_keys(spark, sf_dir):
    df = load(spark, sf_dir, PART)
    return df.select("p_partkey", text_keys.ascii_key(F.col("p_name")).alias("folded"), text_keys.utf16_key(F.col("p_brand")).alias("units"))


_FOLDED = Unit("part", (*(x for x in PART.columns if x.name != "p_name"), Column("p_name", Kind.STRING, collation=text_keys.Collation.UNICODE_IGNORE_CASE)), ("p_partkey",), derived=(Derived("name_key", "p_name", text_keys.UNICODE_FOLD),))


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(upper(p_name), 'S')")
def folded_prefix(spark, sf_dir):
    """The key is stored when rows are written; the query compares it, and the scan takes the filter."""
    _, s = _filled(spark, sf_dir, _FOLDED)
    return shown(plans.plan(s.df(), Query(_FOLDED, StartsWith(_FOLDED.column("p_name"), "s"), columns=("p_partkey", "p_name"))))


# writes, on a store in the shared folder


def _store(spark: SparkSession) -> Store:
    return Store(spark, work_folder(spark), buckets=8)


def _filled(spark: SparkSession, sf_dir: str, unit: Unit):
    store = _store(spark)
    store.create(unit)
    s = store.session(unit)
    s.append_rows(load(spark, sf_dir, unit).select(*(f"`{x.name}`" for x in unit.columns)))
    return store, s


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 3")
def retention_keep_newest(spark, sf_dir):
    _, s = _filled(spark, sf_dir, EVENTS)
    s.apply_retention()
    return shown(s.df().select("event_id", "user_id", "ts"))


@query("SELECT c_custkey, c_name, cast(CASE WHEN c_mktsegment = 'BUILDING' THEN cast(c_acctbal AS decimal(18,4)) + 100 ELSE cast(c_acctbal AS decimal(18,4)) END AS double) AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END::bigint AS version FROM customer UNION ALL SELECT c_custkey + 100000000, c_name, cast(cast(c_acctbal AS decimal(18,4)) AS double), 1::bigint FROM customer WHERE c_nationkey = 7")
def upsert_merge(spark, sf_dir):
    _, s = _filled(spark, sf_dir, CUSTOMER)
    now = load(spark, sf_dir, CUSTOMER)
    names = [x.name for x in CUSTOMER.columns]
    changed = now.where("c_mktsegment = 'BUILDING'").withColumn("c_acctbal", F.col("c_acctbal") + 100).select(*names)
    new = now.where("c_nationkey = 7").withColumn("c_custkey", F.col("c_custkey") + 100000000).select(*names)
    s.upsert_all(changed.unionByName(new))
    return shown(s.df().select("c_custkey", "c_name", "c_acctbal", F.col("__quern_version").alias("version")))


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 5")
def delete_rows(spark, sf_dir):
    _, s = _filled(spark, sf_dir, CUSTOMER)
    s.delete_all(load(spark, sf_dir, CUSTOMER).where("c_nationkey = 5").select("c_custkey"))
    return shown(s.df().select("c_custkey", "c_name"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT (c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 1))")
def compare_and_delete(spark, sf_dir):
    """The first customer goes, since its segment is what is expected; the second stays, since its is not."""
    _, s = _filled(spark, sf_dir, CUSTOMER)
    a, b = s.df().orderBy("c_custkey").select("c_custkey", "c_mktsegment").limit(2).collect()
    s.compare_and_delete({"c_mktsegment": a.c_mktsegment}, c_custkey=a.c_custkey)
    s.compare_and_delete({"c_mktsegment": "no such segment"}, c_custkey=b.c_custkey)
    return shown(s.df().select("c_custkey", "c_mktsegment"))


@query("SELECT 1::bigint AS k, 'last' AS name UNION ALL SELECT 3::bigint, 'three'")
def batch_coalesce(spark, sf_dir):
    """Of the writes for a key the last wins; they commit together."""
    unit = Unit("batch", (col("k", Kind.INT64, False), col("name", Kind.STRING)), ("k",))
    store = _store(spark)
    store.create(unit)
    work = store.unit_of_work(unit, exact=True)
    for w in (Write("upsert", {"k": 1, "name": "first"}), Write("upsert", {"k": 2, "name": "two"}), Write("upsert", {"k": 1, "name": "last"}), Write("insert", {"k": 3, "name": "three"})):
        work.stage(w)
    work.commit()
    again = UnitOfWork(store.session(unit), 1000, False)
    again.stage(Write("delete", {"k": 2}))
    again.commit()
    return store.session(unit).df().select("k", "name")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, (SELECT count(*) FROM events) AS high FROM events")
def append_replay_sequence(spark, sf_dir):
    """Events appended with provider numbers, and again with the same operation id: once in all."""
    unit = Unit("log", (Column("seq", Kind.INT64, False, generated="sequence"), col("event_id", Kind.INT64, False), col("event_type", Kind.STRING)), ("seq",), append_window_s=600)
    store = _store(spark)
    store.create(unit)
    s = store.session(unit)
    some = load(spark, sf_dir, EVENTS).select("event_id", "event_type")
    s.append("import-1", some)
    s.append("import-1", some)
    return s.df().agg(F.count("seq").alias("n"), F.countDistinct("event_id").alias("ids"), F.max("seq").alias("high"))


@query("SELECT p_partkey, p_brand, translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS brand_key, 'none' AS note FROM part")
def schema_evolution(spark, sf_dir):
    """A column with a default and a stored search key are added to a filled unit."""
    from quern import schema

    first = Unit("part", (col("p_partkey", Kind.INT64, False), col("p_brand", Kind.STRING)), ("p_partkey",))
    store = _store(spark)
    store.create(first)
    store.session(first).append_rows(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand"))
    second = Unit("part", (*first.columns, col("note", Kind.STRING, False, default="none")), ("p_partkey",), derived=(Derived("brand_key", "p_brand", text_keys.ASCII_FOLD),), version=2)
    schema.apply(store, second)
    return store.session(second).df().select("p_partkey", "p_brand", "brand_key", "note")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append(spark, sf_dir):
    """Events streamed into a unit, each micro-batch once."""
    from quern.streaming.streams import append_stream

    unit = Unit("streamed", (col("event_id", Kind.INT64, False), col("event_type", Kind.STRING)), ("event_id",), append_window_s=3600)
    store = _store(spark)
    store.create(unit)
    stream = event_stream(spark, sf_dir).select("event_id", "event_type")
    append_stream(store.session(unit), stream, f"{store.root}/checkpoint", "events").awaitTermination()
    return store.session(unit).df().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events as a stream, be it a file or a folder."""
    source = f"{sf_dir}/events.parquet"
    folder, names = (source, "*.parquet") if _is_folder(spark, source) else (sf_dir, "events.parquet")
    return spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", names).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


QUERIES = {k.rstrip("_"): v for k, v in QUERIES.items()}
ORACLE = {k.rstrip("_"): v for k, v in ORACLE.items()}
