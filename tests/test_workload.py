"""Every registered query against its DuckDB text at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quern import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and abs(a - b) <= 1e-6 * max(1, abs(a))
    return a == b


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, duck, name):
    df = workload.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in workload.ORACLE:
        assert got
        return
    cur = duck.execute(workload.ORACLE[name])
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(df.columns) and len(want) == len(got)
    key = lambda r: tuple(f"{v:.4f}" if isinstance(v, float) else repr(v) for v in r)
    a, b = sorted((tuple(r[n] for n in names) for r in got), key=key), sorted(want, key=key)
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))
