"""Queries against their SQL on small tables that hold what the driver's smallest tables don't."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from palimpsest.plans import analysis, base, series, streams  # noqa: F401
from tests.test_queries import shown


def same(spark, folder, name, **tables):
    """Whether a query and its SQL give the same rows over tables, which are written to folder first."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(base.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = [tuple(map(shown, r)) for r in base.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    return sorted(got) == sorted(tuple(map(shown, r)) for r in want.fetchall())


def test_configurations_round_times_to_seconds(spark, tmp_path):
    # half a second before an hour is that hour; before 1970, hours count towards 0
    ts = [3600_000_000 * h + us for h in (0, 1, 24, 25, 49, -2) for us in (-500_001, -500_000, -400_000, 0, 1_500_000)]
    n = len(ts)
    events = pa.table({"event_id": range(n), "ts": pa.array(ts, pa.timestamp("us")), "user_id": [i % 2 for i in range(n)], "event_type": ["signup" if i % 7 == 0 else "view" for i in range(n)], "value": [1.5 * i for i in range(n)], "props": ["{}"] * n})
    assert same(spark, tmp_path, "configurations_in_one_pass", events=events)


def test_real_only_log_with_a_removal_in_the_last_december(spark, tmp_path):
    # orders a month: a put, a put in December, and a December of 7 orders, which is a removal
    months = ["1996-11"] * 3 + ["1996-12"] * 4 + ["1997-05"] * 5 + ["1997-12"] * 7 + ["1998-01"] * 2
    dates = pa.array([f"{m}-0{1 + i % 9}" for i, m in enumerate(months)]).cast(pa.date32()).cast(pa.timestamp("us"))
    dates = pa.concat_arrays([dates, pa.array([None], dates.type)])
    orders = pa.table({"o_orderkey": range(len(dates)), "o_orderdate": dates, "o_orderpriority": ["1-URGENT"] * len(dates)})
    assert same(spark, tmp_path, "real_only_log", orders=orders)


def test_float_texts_of_odd_balances(spark, tmp_path):
    # no balance, one below zero that rounds to -0, and eleven digits: ties go to the even digit of the exact value
    balances = [None, -0.0, 0.0, -999.85, 123456789.25, 1234567890.5, 1000000.0005, 0.5 / 3, float("inf"), -float("inf"), float("nan"), 5e-324]
    customer = pa.table({"c_custkey": range(len(balances)), "c_acctbal": pa.array(balances, pa.float64())})
    assert same(spark, tmp_path, "float_texts", customer=customer)
