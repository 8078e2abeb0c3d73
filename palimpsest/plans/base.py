"""The stand-ins: how the driver's tables play the parts of partitions, logs and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its name, with the SQL that gives the same rows."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with the month of their partition."""
    return table(spark, sf, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))


ITEMS = "items as (select *, strftime(l_shipdate, '%Y-%m') as month from lineitem)"


def log(spark: SparkSession, sf: str) -> DataFrame:
    """A change log: each priority is a path; each month of orders replaces it, or removes it when the
    month's count divides by 7."""
    n = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    path = F.concat(F.lit("orders/p"), F.substring("o_orderpriority", 1, 1), F.lit("/part.parquet"))
    idx = F.dense_rank().over(Window.orderBy(F.col("month").asc_nulls_last())) - 1  # months are few
    sha = F.when(F.col("n") % 7 != 0, F.md5(F.concat_ws(":", path, "month", F.col("n").cast("string"))))
    return n.select(path.alias("path"), idx.cast("long").alias("idx"), sha.alias("sha"), "month", "n")


LOG = """log as (
  select path, idx, case when n % 7 <> 0 then md5(concat_ws(':', path, month, n)) end as sha, month, n from (
    select 'orders/p' || substr(o_orderpriority, 1, 1) || '/part.parquet' as path, month, n, dense_rank() over (order by month) - 1 as idx
    from (select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority, count(*) as n from orders group by 1, 2)))"""

INTERVALS = LOG + """, intervals as (
  select path, sha, valid_from, valid_to from (
    select path, sha, idx as valid_from, lead(idx) over (partition by path order by idx) as valid_to from log) where sha is not null)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of a snapshot: one file per month and status of orders."""
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m"), "o_orderstatus").distinct()
    return o.select(F.concat(F.lit("lake/"), F.substring("m", 1, 4), F.lit("/orders_"), "o_orderstatus", F.lit("_"), "m", F.lit(".parquet")).alias("path"))


FILES = "files as (select distinct 'lake/' || strftime(o_orderdate, '%Y') || '/orders_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y-%m') || '.parquet' as path from orders)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Read records: a user is a key and their events, in order, are its reads."""
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    tok = F.floor("value").cast("long")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    derives = kind.isin("signup", "purchase")
    return e.select(
        F.col("user_id").alias("iid"),
        t.alias("t"),
        F.col("ts").alias("time"),
        "event_id",
        (kind != "error").alias("served_valid"),
        (~kind.isin("error", "view")).alias("stored_valid"),
        kind.isin("signup", "view").alias("flagged"),
        F.when(kind == "signup", "rederive").when(kind == "purchase", "repair").when(kind == "view", "memo").otherwise("same").alias("action"),
        F.when(derives | (kind == "view"), tok).otherwise(F.lit(0)).alias("eval_tok"),
        F.when(derives, tok * 10).otherwise(F.lit(0)).alias("der_tok"),
        F.concat(F.lit("a"), (tok % 3).cast("string")).alias("answer"),
        F.concat(F.lit("s"), (tok % 4).cast("string")).alias("state"),
    )


RECORDS = """records as (
  select user_id as iid, row_number() over (partition by user_id order by ts, event_id) as t, ts as time, event_id,
    event_type <> 'error' as served_valid, event_type not in ('error', 'view') as stored_valid, event_type in ('signup', 'view') as flagged,
    case event_type when 'signup' then 'rederive' when 'purchase' then 'repair' when 'view' then 'memo' else 'same' end as action,
    case when event_type in ('signup', 'purchase', 'view') then floor(value)::bigint else 0 end as eval_tok,
    case when event_type in ('signup', 'purchase') then floor(value)::bigint * 10 else 0 end as der_tok,
    'a' || (floor(value)::bigint % 3) as answer, 's' || (floor(value)::bigint % 4) as state
  from events)"""
