"""Queries of sources that are files: tables written as shards, CSV files and archives, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators import observe
from palimpsest.plans.base import query, table
from palimpsest.sources import readers, sinks, working


def _folder(spark) -> str:
    return f"{working.folder(spark)}/palimpsest-files-{uuid.uuid4().hex}"


@query("select o_orderkey, case when o_orderkey % 2 = 0 then 'first' else 'late' end as source, o_orderstatus as status from orders")
def json_shards(spark, sf):
    """Two sets of JSON-lines shards with orders in common, of which the first set's win; broken lines are skipped."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    paths = []
    for name, rows in (("first", o.where("o_orderkey % 2 = 0")), ("late", o)):
        at = _folder(spark)
        text = rows.select(F.to_json(F.struct("o_orderkey", "status", F.lit(name).alias("source"))).alias("value"))
        broken = rows.where("o_orderkey % 10 = 0").select(F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "status": ')).alias("value"))
        text.unionByName(broken).write.text(at)
        paths += sorted(spark.read.text(at).inputFiles())
    return readers.read_shards(spark, paths, "o_orderkey long, source string, status string", ["o_orderkey"]).select("o_orderkey", "source", "status")


@query(
    """select 'F' as kind, o_orderkey::varchar as k, o_custkey::varchar as customer, null::varchar as priority from orders where o_orderstatus = 'F'
    union all select 'O', o_orderkey::varchar, null, o_orderpriority from orders where o_orderstatus = 'O'"""
)
def csv_by_name(spark, sf):
    """CSV files with different headers, every column as text, united by name."""
    o = table(spark, sf, "orders")
    at = [_folder(spark), _folder(spark)]
    o.where("o_orderstatus = 'F'").select(F.lit("F").alias("kind"), F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("customer")).write.option("header", True).csv(at[0])
    o.where("o_orderstatus = 'O'").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("k"), F.lit("O").alias("kind")).write.option("header", True).csv(at[1])
    return readers.read_csv_text(spark, at).select("kind", "k", "customer", "priority")


@query(
    """with r as (select n_regionkey, count(*) as n, min(n_name) as first from nation group by 1)
    select '| region | n | first |' || chr(10) || '|---|---|---|' || chr(10) || string_agg('| ' || r_name || ' | ' || n || ' | ' || first || ' |', chr(10) order by r_name) || chr(10) as report from r join region on r_regionkey = n_regionkey"""
)
def markdown_report(spark, sf):
    """A small result as a Markdown table."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"), F.min("n_name").alias("first"))
    rows = n.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), "n", "first").orderBy("region")
    return spark.createDataFrame([(sinks.markdown(rows),)], "report string")


@query("select row_number() over (order by a, b) as place, a, b from (select distinct o_orderstatus as a, coalesce(o_orderpriority, 'NULL') as b from orders)")
def canonical_row_order(spark, sf):
    """A result without an order of its own, in that of its values as text; numbered as it comes."""
    rows = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b")).distinct()
    ordered = observe.canonical_rows(rows, "select distinct a, b from orders").coalesce(1)  # a result that is shown
    return ordered.select((F.monotonically_increasing_id() + 1).alias("place"), "a", "b")
