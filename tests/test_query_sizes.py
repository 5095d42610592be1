"""Queries of the item engine on tables that go beyond the test data's key ranges and sizes."""

import tracemalloc

import duckdb

from itemloom import queries
from itemloom.operators import api
from tests.test_queries import plain


def compared(spark, duck, name, sf_dir):
    """The rows of a query and of its SQL, as plain text in order."""
    got, want = queries.QUERIES[name](spark, str(sf_dir)), duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    return sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()), sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_batch_get_of_any_user(spark, tmp_path):
    """Users beyond 199, below 0 and at both ends of their type; an event of two users, a repeated row, absent users."""
    duck, top = duckdb.connect(), 2**63 - 1
    rows = [(5, 800), (40, 199), (40, 200), (77, -3), (77, -3), (77, 2), (123, top), (500, -top - 1), (500, None), (6, 800), (41, -801)]
    duck.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE)")
    duck.executemany("INSERT INTO events VALUES (?, ?, 'view', 1.5)", rows)
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got, want = compared(spark, duck, "batch_get", tmp_path)
    assert got == want and len(got) == 8


def test_scan_pages_holds_few_items(spark, tmp_path, monkeypatch):
    """Names of 2 KB: all returned items together would be over 24 MB here."""
    duck, n = duckdb.connect(), 8000
    duck.execute(f"CREATE TABLE customer AS SELECT i AS c_custkey, repeat(chr((65 + i % 26)::INT), 2000) || i AS c_name, 0::INT AS c_nationkey, (i * 7 % 10000)::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM range({n}) r(i)")
    duck.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    monkeypatch.setattr(queries, "HELD", 500, raising=False)
    monkeypatch.setattr(api, "AHEAD_BYTES", 1 << 20, raising=False)
    tracemalloc.start()
    try:
        df = queries.QUERIES["api_scan_pages"](spark, str(tmp_path))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    df.write.parquet(f"{tmp_path}/out")
    duck.execute(f"CREATE VIEW got AS SELECT c_custkey, c_name, how FROM '{tmp_path}/out/*.parquet'")
    duck.execute(f"CREATE VIEW want AS SELECT c_custkey, c_name, how FROM ({queries.ORACLE_SQL['api_scan_pages']})")
    assert duck.execute("SELECT (SELECT count(*) FROM got), (SELECT count(*) FROM (FROM got EXCEPT ALL FROM want)), (SELECT count(*) FROM (FROM want EXCEPT ALL FROM got))").fetchone() == (n + duck.execute("SELECT count(*) FROM customer WHERE c_acctbal > 5000").fetchone()[0], 0, 0)
    assert peak < 16 << 20


def test_scan_pages_of_no_rows(spark, tmp_path):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer (c_custkey BIGINT, c_name VARCHAR, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment VARCHAR)")
    duck.execute(f"COPY customer TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    assert compared(spark, duck, "api_scan_pages", tmp_path) == ([], [])
