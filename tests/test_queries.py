"""Every registered query of the item engine against its SQL."""

import glob
import os

import duckdb
import pytest

from itemloom import queries

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return repr(round(float(v), 6))
    return repr([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in got.collect()) == sorted(tuple(plain(dict(zip(columns, r))[c]) for c in sorted(columns)) for r in want.fetchall())
