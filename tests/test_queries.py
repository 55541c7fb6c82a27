"""Each registered query against its SQL in DuckDB, over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    found = duck.execute(SQL[name])
    order = [d[0] for d in found.description]
    assert sorted(order) == names
    at = [order.index(c) for c in names]
    expected = sorted([plain(row[i]) for i in at] for row in found.fetchall())
    assert sorted([plain(row[c]) for c in names] for row in df.collect()) == expected


def test_entry_has_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns and df.schema == __spark_entry__.entry(spark).schema
