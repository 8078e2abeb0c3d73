"""Every query of the engine against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

from palimpsest.plans import analysis, base, deltas, dependencies, exchange, facts, lake, maintenance, series, snapshots, streams, traces  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def shown(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query(spark, duck, name):
    got = base.QUERIES[name](spark, SF)
    want = duck.execute(base.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    a = sorted(tuple(map(shown, r)) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    b = sorted(tuple(map(shown, r)) for r in want.fetchall())
    assert a == b


def test_queries_without_sql_are_few():
    assert set(base.QUERIES) - set(base.ORACLES) == {"approximate_distinct"}
