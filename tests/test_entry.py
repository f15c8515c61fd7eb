import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
CORE = [n for m in entry._MODULES if m is not entry._llm for n in m.QUERIES]


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    return x if x is None or isinstance(x, (int, bool)) else str(x)


def against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DIR}/{f}'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", CORE)
def test_core_queries(spark, name):
    against_sql(spark, name)


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "rank", "vec_id", "cluster_id", "dist"]
