"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import datetime
import glob
import math
import os
import subprocess
import sys

import __spark_entry__ as entry
import duckdb
import pytest


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        v = v.replace(tzinfo=None)
    return str(v)


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


CORE = sorted(entry.load()[0])


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, duck, name):
    df = entry.load()[0][name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    sql = entry.load()[1].get(name)
    if sql:
        q = duck.execute(sql)
        names = [x[0] for x in q.description]
        assert sorted(names) == cols
        assert got == sorted(tuple(value(r[names.index(c)]) for c in cols) for r in q.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['palimpsest.llm'] = None; import __spark_entry__ as e; assert e.llm is None and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
