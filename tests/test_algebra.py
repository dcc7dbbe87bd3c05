"""Compiled predicates against their definition in Python, over an enumerated corpus of shapes and edge rows."""

import datetime as dt
import itertools
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import types as T

from quern.errors import Refused
from quern.functions import identity, text_keys
from quern.model import Access, Collation, Column, Constant, Derived, ElementSet, Index, IndexColumn, Kind, Unit, declare, validate_unit
from quern.normalize import normalize
from quern.operators.fluent import Table
from quern.plans import coverage
from quern.plans import query as plans
from quern.plans.compile import Order, order_key, to_column
from quern.plans.query import Latest, Page, Query, Scan
from quern.predicates import FALSE, TRUE, And, Compare, Not, Or, StartsWith, Substring, among, between, canonical, element_of, eq, evaluate, validate

UTC = dt.timezone.utc
UNIT = Unit(
    "rows",
    (
        Column("id", Kind.INT64, False),
        Column("text", Kind.STRING),
        Column("plain", Kind.STRING, plain_text=True),
        Column("num", Kind.DECIMAL),
        Column("other", Kind.DECIMAL),
        Column("flag", Kind.BOOLEAN),
        Column("at", Kind.TIMESTAMP),
        Column("made", Kind.TIMESTAMP, False),
        Column("guid", Kind.GUID),
        Column("raw", Kind.BINARY),
    ),
    ("id",),
    element_sets=(ElementSet("tags", Kind.STRING),),
    indexes=(Index("ix_num", (IndexColumn("num"), IndexColumn("id"))), Index("ix_flag_at", (IndexColumn("flag"), IndexColumn("at", True)))),
)
C = {c.name: c for c in UNIT.columns}
TAGS = UNIT.element_set("tags")
TEXTS = [None, "", " ", "I", "i", "İ", "ı", "Straße", "STRASSE", "é", "é", "\U00010000", "", "a%b", "a_b", "zz"]


def make_rows():
    r, out = random.Random(5), []
    for i in range(40):
        t = dt.datetime(2024, 1, 1, tzinfo=UTC) + dt.timedelta(hours=r.randint(-50, 50), microseconds=r.randint(0, 3))
        out.append(
            {
                "id": i,
                "text": TEXTS[i % len(TEXTS)],
                "plain": [None, "", "a", "ab", "b"][i % 5],
                "num": None if i % 6 == 0 else D(r.choice(["0.0001", "-1", "12345678901234.5678", "12345678901234.5679", "7"])),
                "other": None if i % 7 == 0 else D(r.choice(["7", "-1", "3.5"])),
                "flag": [None, True, False][i % 3],
                "at": None if i % 8 == 0 else t,
                "made": t.replace(microsecond=0),
                "guid": None if i % 9 == 0 else f"0000000{i % 4}-0000-0000-0000-00000000000{i % 10}",
                "raw": [None, b"", b"\x00", b"ab"][i % 4],
                "tags": [None, [], ["x"], ["x", "y", None], ["y"]][i % 5],
            }
        )
    return out


ROWS = make_rows()


@pytest.fixture(scope="module")
def frame(spark):
    names = UNIT.visible()
    schema = T.StructType([T.StructField(n, UNIT.schema()[n].dataType) for n in names])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in ROWS], schema).cache()


def leaves():
    t0 = dt.datetime(2024, 1, 1, tzinfo=UTC)
    yield from (eq(C["text"], v) for v in [*TEXTS, "missing"])
    yield from (eq(C["num"], v) for v in (None, D("7"), D("12345678901234.5678")))
    yield from (eq(C[n], v) for n, v in (("flag", True), ("flag", None), ("raw", b""), ("raw", None), ("guid", "00000001-0000-0000-0000-000000000001"), ("at", None)))
    yield from (among(C["text"], v) for v in ([], [None], ["I", None], ["é", "é"], ["Straße"]))
    yield from (among(C["num"], v) for v in ([D("7"), D("-1")], [None, D("0.0001")]))
    for n, lo, hi in (("num", D("-1"), D("7")), ("text", "I", "é"), ("text", "\U00010000", None), ("text", "", None), ("plain", "a", "b"), ("at", t0, t0 + dt.timedelta(hours=9)), ("guid", "00000001-0000-0000-0000-000000000000", None)):
        for a, b in itertools.product((True, False), repeat=2):
            yield between(C[n], lo, hi, a, b)
    yield from (StartsWith(C["text"], p) for p in ("", "S", "a%", "I", "\U00010000"))
    yield from (Substring(C["text"], p, e) for p in ("", "%", "_", "ß", "e") for e in (True, False))
    yield from (element_of(TAGS, v, e) for v in ([], ["x"], ["x", "y"], [None], ["none"]) for e in (True, False))
    yield from (Compare(C["num"], op, C["other"]) for op in ("=", "<>", "<", "<=", ">", ">="))


LEAVES = list(leaves())


def shapes():
    yield from LEAVES
    yield from (Not(p) for p in LEAVES if not validate(Not(p)))
    r = random.Random(2)
    for _ in range(120):
        a, b, c = r.sample(LEAVES, 3)
        yield r.choice([And((a, b)), Or((a, b)), And((a, Or((b, c)))), Or((a, And((b, c)))), And(()), Or(()), Not(And((a, b))), Not(Or((a, Not(b))))])
    yield from (TRUE, FALSE)


def test_compiled_is_defined(frame):
    every = list(shapes())
    assert len(every) > 200
    flags = frame.select("id", *(to_column(p).alias(f"p{i}") for i, p in enumerate(every))).collect()
    for row in flags:
        for i, p in enumerate(every):
            assert bool(row[f"p{i}"]) == evaluate(p, ROWS[row["id"]]), (canonical(p), ROWS[row["id"]])


def test_normal_form_is_equivalent():
    for p in shapes():
        q = normalize(p)
        assert normalize(q) == q
        for row in ROWS:
            assert evaluate(p, row) == evaluate(q, row), (canonical(p), canonical(q), row)


def test_normal_form_fuses():
    assert normalize(Or((eq(C["text"], "a"), eq(C["text"], "b")))) == among(C["text"], ["a", "b"])
    assert normalize(And((between(C["num"], D(1)), between(C["num"], None, D(1))))) == eq(C["num"], D(1))
    assert normalize(And((eq(C["text"], "a"), eq(C["text"], "b")))) == FALSE
    assert normalize(among(C["text"], [])) == FALSE
    wide = And(tuple(Or((eq(C["text"], str(i)), eq(C["num"], D(i)))) for i in range(70)))
    with pytest.raises(Refused, match="QN-QUERY-020"):
        normalize(wide)


@pytest.mark.parametrize(
    "p",
    [Not(among(C["text"], ["a"])), Not(between(C["num"], D(1))), Not(StartsWith(C["text"], "a")), between(C["flag"], True), between(C["raw"], b"a"), Compare(C["flag"], "<", C["flag"]), StartsWith(Column("x", Kind.STRING, collation=Collation.ASCII_IGNORE_CASE), "a")],
)
def test_refused_shapes(p):
    assert validate(p, None)
    for row in ROWS[:5]:
        if not (isinstance(p, StartsWith) or "flag" in str(p) or "raw" in str(p)):
            evaluate(p, row)


def test_constants_are_exact():
    for column, value in ((C["num"], 1), (C["num"], D("0.00001")), (C["id"], True), (C["id"], 1 << 63), (C["at"], dt.datetime(2024, 1, 1)), (C["text"], "\ud800"), (C["guid"], "nope"), (Column("s", Kind.STRING, max_length=1), "ab"), (Column("f", Kind.DOUBLE), 1.0)):
        with pytest.raises(Refused):
            Constant.of(column, value)


def python_order(orders):
    def key(row):
        out = []
        for o in orders:
            k = Constant.of(o.column, row[o.column.name])
            null = k.value is None
            out.append((0 if null == o.nulls_first else 1, _Turned(k.order_key()) if o.descending else k.order_key()))
        return out

    return key


class _Turned:
    def __init__(self, k):
        self.k = k

    def __lt__(self, other):
        return other.k < self.k

    def __eq__(self, other):
        return self.k == other.k


@pytest.mark.parametrize("name", ["text", "plain", "num", "at", "guid"])
@pytest.mark.parametrize("down", [True, False])
@pytest.mark.parametrize("first", [True, False])
def test_keyset_pages_are_the_sorted_rows(frame, name, down, first):
    q = Query(UNIT, order=(Order(C[name], down, first),), columns=("id",), page=Page(7, keyset=True), total_count=True)
    want = [r["id"] for r in sorted(ROWS, key=python_order([*q.order, Order(C["id"])]))]
    got, token = [], None
    while True:
        page = plans.run(frame, Query(q.unit, q.where, q.order, q.columns, Page(7, 0, True, token), True))
        got += [r["id"] for r in page.rows]
        assert page.total_count == len(ROWS)
        if (token := page.next_token) is None:
            break
    assert got == want
    assert [r["id"] for r in plans.plan(frame, Query(UNIT, order=q.order, page=Page(5, 3))).collect()] == want[3:8]


def test_tokens_are_bound(frame):
    q = Query(UNIT, order=(Order(C["at"]),), page=Page(3, keyset=True))
    token = plans.run(frame, q).next_token
    for other, access in ((Query(UNIT, eq(C["flag"], True), q.order, page=Page(3, 0, True, token)), Access()), (Query(UNIT, order=(Order(C["num"]),), page=Page(3, 0, True, token)), Access()), (Query(UNIT, order=q.order, page=Page(3, 0, True, token[:-4] + "AAAA")), Access()), (Query(UNIT, order=q.order, page=Page(3, 0, True, token)), Access.to("a"))):
        with pytest.raises(Refused, match="QN-TOKEN-001"):
            plans.decode_token(other.page.token, other, plans.full_order(other), access)
    assert q.fingerprint() != Query(UNIT, eq(C["flag"], True), q.order).fingerprint()
    shape = lambda v: Query(UNIT, eq(C["text"], v)).fingerprint(False)
    assert shape("a") == shape("b")


def test_latest_per_key(frame):
    q = Query(UNIT, latest=Latest(C["flag"], C["made"]), columns=("id",))
    want = {}
    for r in sorted(ROWS, key=lambda r: (-r["made"].timestamp(), r["id"])):
        want.setdefault(r["flag"], r["id"])
    assert {r["id"] for r in plans.plan(frame, q).collect()} == set(want.values())
    with pytest.raises(Refused, match="LATEST"):
        Query(UNIT, latest=Latest(C["flag"], C["at"]))
    coverage.assert_plan(plans.plan(frame, q), "WindowGroupLimit")


def test_filters_reach_the_scan(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    for p, want in ((eq(C["plain"], "a"), "EqualTo(plain,a)"), (Not(eq(C["plain"], "a")), "Not(EqualNullSafe(plain,a))"), (among(C["plain"], ["a", "b"]), "In(plain"), (between(C["plain"], "a"), "GreaterThanOrEqual(plain,a)"), (StartsWith(C["plain"], "a"), "StringStartsWith(plain,a)")):
        coverage.assert_plan(plans.plan(df, Query(UNIT, p, columns=("id",))), want, without=("Python",))
    assert "ReadSchema: struct<id:bigint,plain:string>" in coverage.plan_text(plans.plan(df, Query(UNIT, eq(C["plain"], "a"), columns=("id",))))


def test_text_order_is_utf16(frame):
    rows = frame.select("text").distinct().where("text is not null").orderBy(order_key(C["text"])).collect()
    assert [r.text for r in rows] == sorted({t for t in TEXTS if t is not None}, key=lambda t: t.encode("utf-16-be"))


def test_coverage():
    today = dt.date(2024, 1, 1)
    covered = lambda q: coverage.check(q, today=today)
    by = lambda n, down=False: (Order(C[n], down),)
    assert covered(Query(UNIT, eq(C["num"], D(1)))).index.name == "ix_num"
    assert covered(Query(UNIT, And((eq(C["flag"], True), between(C["at"], dt.datetime(2024, 1, 1, tzinfo=UTC)))), by("at", True))).covered
    assert covered(Query(UNIT, FALSE)).covered
    assert covered(Query(UNIT, order=by("num"), page=Page(5))).covered
    assert covered(Query(UNIT, eq(C["flag"], True), by("at", False))).covered  # the whole layout read backwards
    for q, code in ((Query(UNIT), "005"), (Query(UNIT, order=by("num")), "005"), (Query(UNIT, Substring(C["text"], "a")), "016"), (Query(UNIT, eq(C["text"], "a")), "006"), (Query(UNIT, total_count=True, order=by("num"), page=Page(1)), "005"), (Query(UNIT, between(C["at"], dt.datetime(2024, 1, 1, tzinfo=UTC))), "006"), (Query(UNIT, Or((eq(C["text"], "a"), eq(C["num"], D(1))))), "016")):
        assert covered(q).refusals[0].code == f"QN-COVER-{code}"
    sparse = Index("s", (IndexColumn("num"),), excludes_missing=True)
    assert coverage.check(Query(UNIT, eq(C["num"], None)), [sparse]).refusals[0].code == "QN-COVER-009"
    scan = lambda d: Scan("S-1", "why", "who", d)
    assert covered(Query(UNIT, accepted_scan=scan(dt.date(2025, 1, 1)))).covered
    assert covered(Query(UNIT, accepted_scan=scan(dt.date(2024, 1, 20)))).warnings[0].code == "QN-COVER-904"
    assert covered(Query(UNIT, accepted_scan=scan(today))).refusals[0].code == "QN-COVER-903"
    assert covered(Query(UNIT, eq(C["num"], D(1)), accepted_scan=scan(dt.date(2025, 1, 1)))).refusals[0].code == "QN-COVER-901"
    gate = coverage.Gate(UNIT.indexes[:1], limit=1)
    gate.admit(Query(UNIT, eq(C["num"], D(1))))
    gate.admit(Query(UNIT, eq(C["num"], D(2))))
    assert len(gate.seen) == 1 and gate.evicted == 0
    with pytest.raises(Refused):
        gate.admit(Query(UNIT, eq(C["flag"], True)))
    assert gate.evicted == 1
    with pytest.raises(Refused, match="FENCE-001"):
        coverage.fence(Query(UNIT, among(C["text"], [str(i) for i in range(1001)])), Access())


def test_declarations():
    assert not validate_unit(UNIT)
    bad = Unit("u", (Column("a", Kind.INT64), Column("a", Kind.STRING), Column("__quern_x", Kind.STRING), Column("d", Kind.DOUBLE)), ("a", "b"), (Index("i", (IndexColumn("nope"),)),), (Derived("k", "nope", "x"),))
    codes = {r.code for r in validate_unit(bad)}
    assert {"QN-PORT-001", "QN-PORT-002", "QN-PORT-003", "QN-PORT-006", "QN-PORT-010", "QN-PORT-011"} <= codes
    with pytest.raises(Refused):
        declare(bad)
    for scope in ("", " a", "a\0", "x" * 129, "__quern_a", "\ud800"):
        with pytest.raises(Refused):
            Access.to(scope)


def test_fluent(frame):
    t = Table(UNIT, frame)
    r = t.row
    assert t.where(r.plain == "a").count() == 8
    assert t.where((r.plain != "a") & r.flag.has_value()).count() == sum(x["plain"] != "a" and x["flag"] is not None for x in ROWS)
    assert t.where(lambda r: r.tags.any_of(["x"])).any()
    assert t.where(r.made.year == 2023).count() == sum(x["made"].year == 2023 for x in ROWS)
    assert t.where(r.made.date == dt.date(2024, 1, 1)).count() == sum(x["made"].date() == dt.date(2024, 1, 1) for x in ROWS)
    ids = [x["id"] for x in t.order_by("num").then_by("id", True).take(5).select("id").to_list().rows]
    want = sorted(ROWS, key=python_order([Order(C["num"], False, False), Order(C["id"], True, True)]))
    assert ids == [x["id"] for x in want[:5]]
    assert t.where_if(False, r.plain == "a").query.where == TRUE
    for wrong in (lambda: r.num + 1, lambda: r.text.lower(), lambda: t.join(t), lambda: t.group_by("a"), lambda: r.nothing, lambda: r.made.year > 3, lambda: r.at > dt.datetime(2024, 1, 1), lambda: bool(r.num), lambda: r.num == D("0.00001"), lambda: t.where(lambda r: True)):
        with pytest.raises(Refused):
            wrong()


def test_text_keys(spark):
    table = text_keys.simple_upper()
    assert len(table) == 1478 and 0xDF not in table and table[0x10428] == 0x10400
    words = ["Straße", "İı", "\U00010428", None, "é"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(text_keys.unicode_key(text_keys.F.col("w")).alias("k"), text_keys.utf16_key(text_keys.F.col("w")).alias("u")).collect()
    for w, g in zip(words, got, strict=True):
        assert g.k == (None if w is None else text_keys.unicode_key_text(w))
        assert g.u == (None if w is None else w.encode("utf-16-be").hex().upper())
    assert text_keys.unicode_key_text("straß") == text_keys.unicode_key_text("STRAß") != text_keys.unicode_key_text("STRASS")
    with pytest.raises(Exception, match="QN-KEY-001"):
        spark.createDataFrame([("é",)], "w string").select(text_keys.ascii_key(text_keys.F.col("w"))).collect()
    assert text_keys.successor("AB") == "AC"


def test_identities():
    for n in (0, 1, 61, 62, 123456789):
        assert identity.from_base62(identity.base62(n)) == n
    v7 = identity.UuidV7(lambda: 1_700_000_000.0)
    ids = [v7() for _ in range(50)]
    assert ids == sorted(ids) and len(set(ids)) == 50
    flake = identity.Snowflake(3, clock=lambda: 1_800_000_000.0)
    made = [flake() for _ in range(5000)]
    assert made == sorted(set(made))
    assert identity.canonical_json('{"b":1,"a":{"d":2,"c":[1]}}') == '{"a":{"c":[1],"d":2},"b":1}'
