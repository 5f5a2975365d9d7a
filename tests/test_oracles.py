"""Every query with SQL gives the rows that DuckDB gives, at the small scale."""

import os

import duckdb
import pytest

import weftline.plans.queries  # noqa: F401
from weftline.plans import registry

DIR = os.environ.get("WEFTLINE_SF", "/root/testdata/sf0.001")


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, name):
    got = registry.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
