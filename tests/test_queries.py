"""Each query against its SQL on the small tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from peakloom.plans import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(round(v[i], 6) if isinstance(v[i], float) else v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    if name in own.ORACLE_SQL:
        want = db.sql(own.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert got == rows(want.fetchall(), want.columns)
    else:
        assert got


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_grouping_takes_every_sample(spark, db):
    groups = own.QUERIES["group_between_samples"](spark, SF)
    want = db.sql("SELECT DISTINCT user_id, strftime(CAST(ts AS DATE), '%Y%m%d') AS day FROM events WHERE value IS NOT NULL").fetchall()
    rows = groups.select("sample", "idtab", "group_id").collect()
    assert sorted((r.sample, r.idtab) for r in rows) == sorted((u, f"{u}-{d}") for u, d in want)
    assert any(u % 10 == 0 for u, _ in want)
    # presence counts a sample once for each group, over all samples
    n, held = len({r.sample for r in rows}), {}
    for r in rows:
        held.setdefault(r.group_id, set()).add(r.sample)
    ref = own.QUERIES["assemble_reference_map"](spark, SF).collect()
    assert sorted(round(r.presence, 6) for r in ref) == sorted(round(100 * len(x) / n, 6) for x in held.values() if 100 * len(x) / n >= 2)
