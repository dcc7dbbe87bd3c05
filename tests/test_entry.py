"""The driver's contract: every engine query against its SQL, and the entry without the optional subpackage."""

import datetime as dt
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quern import conformance, queries

ORACLE, QUERIES = queries.ORACLE | conformance.ORACLE, queries.QUERIES | conformance.QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = db.sql(ORACLE[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_jdbc_source_on_executors():
    """Where tasks run in other processes than the driver."""
    code = f"""
from quern import conformance
from quern.session import session
s = session("jdbc", **{{"spark.master": "local-cluster[2,1,1024]", "spark.ui.enabled": "false", "spark.executor.memory": "512m"}})
try:
    for _ in range(2):
        assert sorted(r[0] for r in conformance.jdbc_source(s, "{SF}").collect()) == [n for n in range(25) if n % 5 in (1, 3)]
finally:
    s.stop()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=300)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_engine_stands_alone():
    """Nothing but the entry's guard knows the optional subpackage."""
    block = "import sys; sys.modules['quern.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'keyset_page2' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", block], cwd=ROOT, check=True, timeout=120)
    for f in (ROOT / "quern").rglob("*.py"):
        if "llm" not in f.parts:
            assert "quern.llm" not in f.read_text()
