"""Every query with SQL is held against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from strandframe.plans import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, str(DATA)).toPandas()
    if name not in SQL:
        assert len(got)
        return
    duck.register("got", got)
    duck.execute(f"create or replace temp table want as {SQL[name]}")
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    assert sorted(r[0] for r in duck.execute("describe want").fetchall()) == sorted(got.columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"select {columns} from {a} except all select {columns} from {b}").fetchall() == []
