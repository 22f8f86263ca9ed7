"""Each query against its SQL on an independent engine, as multisets."""

import duckdb
import pytest

from tessera.plans.catalogue import ORACLE, QUERIES, segment_orders
from tessera.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert canon(got.collect(), got.columns) == canon(want.fetchall(), columns)


def test_orders_come_sorted(spark):
    keys = [(r.o_orderpriority, -r.o_orderkey) for r in QUERIES["sort_multi"](spark, SMALL).collect()]
    assert keys == sorted(keys)
    top = QUERIES["topk_limit"](spark, SMALL).collect()
    assert len(top) == 10 and [r.o_totalprice for r in top] == sorted((r.o_totalprice for r in top), reverse=True)


def test_entry(spark):
    assert segment_orders(spark, SMALL).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    assert "LeftSemi" in plan(QUERIES["subquery_in"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,42)]" in plan(QUERIES["filter_eq_int"](spark, SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan(QUERIES["index_range"](spark, SMALL))
    assert "TakeOrderedAndProject" in plan(QUERIES["topk_limit"](spark, SMALL))
