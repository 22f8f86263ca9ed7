"""Operators that SQL can express, against an independent engine on whole tables."""

import duckdb
import pytest

from tessera.llm.oracles import ORACLE
from tessera.llm.queries import QUERIES


@pytest.mark.parametrize("name", ORACLE)
def test_same_as_sql(spark, name):
    small = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    got = QUERIES[name](spark, small)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    cell = lambda v: f"{v:.5f}" if isinstance(v, float) else str(v)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(cell, r)) for r in want.fetchall()) == sorted(tuple(map(cell, r)) for r in got.select(*columns).collect())
