"""The exact operators give the rows of their SQL, at the small scale."""

import duckdb
import pytest

from weftline.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    got = queries.QUERIES[name](spark, DIR)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r) for r in got.select(columns).collect()), key=repr) == sorted(want, key=repr)
