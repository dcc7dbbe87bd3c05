"""Aggregation profiles against plain Python, with the edge cases of each reducer and budget."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import types as T

from quern.errors import Refused
from quern.model import Access, Column, Kind, Unit
from quern.operators.aggregate import AggregateQuery, Count, FirstBy, FixedBucket, Having, LocalDay, Max, Min, Profile, SetUnion, Sum, plan, run, validate_profile
from quern.predicates import StartsWith, between, eq

UTC = dt.timezone.utc
UNIT = Unit(
    "facts",
    (
        Column("id", Kind.STRING, False),
        Column("group", Kind.STRING),
        Column("i", Kind.INT32),
        Column("d", Kind.DECIMAL, precision=28, scale=4),
        Column("label", Kind.STRING),
        Column("low", Kind.INT64, False),
        Column("high", Kind.STRING, False),
        Column("at", Kind.TIMESTAMP),
    ),
    ("id",),
)
SUMMARY = Profile(
    "summary",
    ("group",),
    (Count("n"), Min("min_i", "i"), Max("max_l", "label"), Sum("sum_i", "i"), Sum("sum_d", "d"), SetUnion("labels", "label", 8), FirstBy("first", "label", "low"), FirstBy("last", "label", "low", True), FirstBy("top", "i", "high", True)),
    {"sum_i": ("=", "range"), "labels": ("contains",), "group": ("in",)},
    16,
    64,
)
T0 = dt.datetime(2024, 3, 31, tzinfo=UTC)
ROWS = [
    ("a", "g1", 2**31 - 1, D("123456789012345678901234.5678"), "x\x1fy", 5, "a", T0),
    ("b", "g1", 2**31 - 1, D("0.0001"), "\U00010000", 5, "b", T0 + dt.timedelta(hours=1)),
    ("c", "g1", None, None, "", 9, "b", T0 - dt.timedelta(microseconds=1)),
    ("d", None, None, None, None, -3, "z", None),
    ("e", None, None, None, None, -3, "z", T0 + dt.timedelta(days=40)),
    ("f", "g2", -5, D("-1"), "k", -(2**63), "q", dt.datetime(1969, 12, 31, 23, 59, 59, 999999, tzinfo=UTC)),
    ("g", "g2", 5, D("1"), "k", 2**63 - 1, "r", dt.datetime(1970, 1, 1, tzinfo=UTC)),
]


@pytest.fixture(scope="module")
def frame(spark):
    names = [c.name for c in UNIT.columns]
    return spark.createDataFrame(ROWS, T.StructType([T.StructField(n, UNIT.schema()[n].dataType) for n in names])).cache()


def test_reducers(frame):
    got = {r["group"]: r for r in run(frame, UNIT, SUMMARY, AggregateQuery("summary")).rows}
    g1, none, g2 = got["g1"], got[None], got["g2"]
    assert (g1.n, g1.min_i, g1.sum_i, g1.sum_d) == (3, 2**31 - 1, 2**32 - 2, D("123456789012345678901234.5679"))
    assert g1.labels == ["", "x\x1fy", "\U00010000"] and g1.max_l == "\U00010000"
    assert (g1.first, g1["last"], g1.top) == ("x\x1fy", "", 2**31 - 1)
    assert (none.n, none.min_i, none.sum_i, none.sum_d, none.labels, none.first) == (2, None, None, None, [], None)
    assert (g2.first, g2["last"], g2.sum_d) == ("k", "k", D("0.0000"))


def test_first_by_keeps_nulls_and_breaks_ties_by_key(frame):
    p = Profile("p", (), (FirstBy("x", "i", "high"), FirstBy("y", "i", "high", True), FirstBy("z", "i", "low")))
    row = run(frame, UNIT, p, AggregateQuery("p")).rows[0]
    assert (row.x, row.y, row.z) == (2**31 - 1, None, -5)


def test_first_by_of_repeated_keys_takes_the_first_row_of_the_file(spark, tmp_path):
    """lineitem repeats its key; what SQL gives when it reads the file in order."""
    import duckdb

    from quern import queries

    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute("CREATE TABLE t AS SELECT * REPLACE (l_orderkey // 50 AS l_orderkey) FROM '/root/testdata/sf0.001/lineitem.parquet'")
    con.execute(f"COPY t TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    assert con.sql("SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag) > 1)").fetchall()[0][0] > 100
    want = con.sql(queries.ORACLE["agg_first_by"]).fetchall()
    got = queries.QUERIES["agg_first_by"](spark, str(tmp_path)).select("l_partkey", "last_flag", "first_flag").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_source_and_post_predicates(frame):
    q = AggregateQuery("summary", between(UNIT.column("i"), 0), having=(Having("sum_i", "range", (0, 10)),))
    assert [r["group"] for r in run(frame, UNIT, SUMMARY, q).rows] == ["g2"]
    q = AggregateQuery("summary", having=(Having("labels", "contains", ("k",)), Having("group", "in", ("g1",))), having_any=True, order=(("n", True),), take=1)
    assert [r["group"] for r in run(frame, UNIT, SUMMARY, q).rows] == ["g1"]
    q = AggregateQuery("summary", having=(Having("sum_i", "range", (-10, 10)),))
    assert [r["group"] for r in run(frame, UNIT, SUMMARY, q).rows] == ["g2"]  # a null sum is dropped


def test_budgets_refuse(frame):
    small = lambda **k: Profile("s", ("group",), (Count("n"), SetUnion("labels", "label", 2)), {}, **k)
    for p, code in ((small(max_groups=2), "005"), (small(max_input_rows=6), "004"), (small(), "007")):
        with pytest.raises(Refused, match=f"QN-AGG-BOUND-{code}"):
            run(frame, UNIT, p, AggregateQuery("s"))
    over = Profile("o", (), (Sum("s", "low"),))
    with pytest.raises(Refused, match="QN-AGG-SUM-001"):
        run(frame.where("low > 0").unionAll(frame.where("low > 0")), UNIT, over, AggregateQuery("o"))


def test_fixed_buckets(frame):
    p = Profile("b", (FixedBucket("bucket", "at", dt.timedelta(hours=1)),), (Count("n"),))
    got = {r.bucket.replace(tzinfo=UTC): r.n for r in run(frame, UNIT, p, AggregateQuery("b")).rows}
    want = {}
    for r in ROWS:
        if r[-1] is not None:
            us = (r[-1] - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)
            start = dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=us - us % 3_600_000_000)
            want[start] = want.get(start, 0) + 1
    assert got == want
    origin = dt.datetime(2024, 1, 1, 0, 0, 0, 500, tzinfo=UTC)
    rows = run(frame, UNIT, p, AggregateQuery("b", origin=origin, time_from=T0, time_to=T0 + dt.timedelta(hours=2))).rows
    assert [r.bucket.replace(tzinfo=UTC) for r in rows] == [T0 - dt.timedelta(hours=1) + dt.timedelta(microseconds=500), T0 + dt.timedelta(microseconds=500)]


@pytest.mark.parametrize(
    ("zone", "at", "day"),
    [
        ("Europe/Amsterdam", "2024-03-31T12:00", "2024-03-30T23:00"),  # spring forward
        ("America/Sao_Paulo", "2018-11-04T12:00", "2018-11-04T03:00"),  # no midnight: the first instant that exists
        ("America/Havana", "2023-11-05T12:00", "2023-11-05T04:00"),  # midnight twice: the first
        ("Asia/Kolkata", "2024-01-01T20:00", "2024-01-01T18:30"),
    ],
)
def test_local_days(spark, zone, at, day):
    when = dt.datetime.fromisoformat(at).replace(tzinfo=UTC)
    df = spark.createDataFrame([("a", when)], "id string, at timestamp")
    p = Profile("l", (LocalDay("day", "at"),), (Count("n"),))
    rows = run(df, UNIT, p, AggregateQuery("l", zone=zone)).rows
    assert rows[0].day.replace(tzinfo=UTC) == dt.datetime.fromisoformat(day).replace(tzinfo=UTC)


def test_refusals(frame):
    bad = [
        Profile("x", ("group",), ()),
        Profile("x", ("group",), (Count("group"),)),
        Profile("x", (), (Sum("s", "label"),)),
        Profile("x", (), (SetUnion("s", "i", 3),)),
        Profile("x", (), (FirstBy("s", "i", "at"),)),
        Profile("x", (FixedBucket("b", "i", dt.timedelta(1)),), (Count("n"),)),
        Profile("x", (), (Count("n"),), {"nope": ("=",)}),
    ]
    for p in bad:
        with pytest.raises(Refused, match="QN-AGG-DECL"):
            validate_profile(p, UNIT)
    for q in (
        AggregateQuery("summary", StartsWith(UNIT.column("label"), "a")),
        AggregateQuery("summary", having=(Having("n", "range", (1, 2)),)),
        AggregateQuery("summary", order=(("labels", False),)),
        AggregateQuery("summary", take=17),
        AggregateQuery("summary", zone="UTC"),
    ):
        with pytest.raises(Refused, match="QN-AGG"):
            plan(frame, UNIT, SUMMARY, q)
    with pytest.raises(Refused, match="ZONE-002"):
        plan(frame, UNIT, Profile("l", (LocalDay("day", "at"),), (Count("n"),)), AggregateQuery("l", zone="Mars/Base"))
    with pytest.raises(Refused, match="QN-AGG-SCOPE"):
        plan(frame, UNIT, SUMMARY, AggregateQuery("summary"), Access.across("a", "b"))


def test_fingerprints(frame):
    a, b = (run(frame, UNIT, SUMMARY, AggregateQuery("summary", eq(UNIT.column("label"), v))) for v in ("k", "l"))
    assert a.shape_fingerprint == b.shape_fingerprint and a.value_fingerprint != b.value_fingerprint
