"""Queries of the fact families: partition and running aggregates, top-k, joins, quality, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import profile
from palimpsest.plans.base import ITEMS, items, query, table

NUMBERS = ["l_extendedprice", "l_discount", "l_tax"]


def profiles(spark, sf):
    return profile.profile(items(spark, sf), "month", "l_shipdate", NUMBERS)


_P = ", ".join(f"count({c}) as nn_{c}, sum(round({c}, 2)::decimal(18,2)) as sum_{c}, count_if({c} < 0) as neg_{c}, count_if({c} = 0) as zero_{c}" for c in NUMBERS)
PROFILE = f"{ITEMS}, prof as (select month, count(*) as n, min(l_shipdate) as min_ts, max(l_shipdate) as max_ts, 0::bigint as n_outside, {_P} from items group by month)"


@query(f"with {PROFILE} select * from prof")
def partition_profile(spark, sf):
    return profiles(spark, sf)


@query(f"with {PROFILE} select month, sum(n) over (order by month)::bigint as n, sum(sum_l_extendedprice) over (order by month) as total from prof")
def running_aggregate_by_snapshot(spark, sf):
    return profile.running(profiles(spark, sf), "month", {"n": "n", "total": "sum_l_extendedprice"})


@query(f"with {ITEMS} select substr(month, 1, 4) as year, sum(round(l_extendedprice, 2)::decimal(18,2)) as total, count(*) as n from items group by 1")
def exact_decimal_sum(spark, sf):
    p = profiles(spark, sf)
    return p.groupBy(F.substring("month", 1, 4).alias("year")).agg(F.sum("sum_l_extendedprice").alias("total"), F.sum("n").alias("n"))


@query(f"with {PROFILE} select month, round_even(sum_l_discount::decimal(18,2) / nn_l_discount, 4)::decimal(20,4) as mean_discount from prof")
def mean_half_even(spark, sf):
    return profiles(spark, sf).select("month", profile.mean("sum_l_discount", "nn_l_discount").alias("mean_discount"))


@query(f"with {ITEMS} select month, count(distinct l_suppkey) as n_suppliers, count(distinct upper(trim(l_returnflag))) as n_flags from items group by 1")
def distinct_bases(spark, sf):
    return items(spark, sf).groupBy("month").agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct(F.upper(F.trim("l_returnflag"))).alias("n_flags"))


@query(f"with {ITEMS}, c as (select substr(month, 1, 4) as year, l_suppkey, count(*) as n from items group by 1, 2), r as (select *, row_number() over (partition by year order by n desc, l_suppkey) as k from c) select year, string_agg(l_suppkey::varchar, ', ' order by k) as answer from r where k <= 5 group by year")
def topk_with_ties(spark, sf):
    c = profile.keyed_counts(items(spark, sf).withColumn("year", F.substring("month", 1, 4)), "year", "l_suppkey")
    return profile.top_text(c, ["year"], "l_suppkey", "n", 5)


@query(f"with {ITEMS} select year, month, n from (select substr(month, 1, 4) as year, month, count(*) as n, row_number() over (partition by substr(month, 1, 4) order by count(*) desc, month) as k from items group by 1, 2) where k = 1")
def busiest_month(spark, sf):
    c = profile.keyed_counts(items(spark, sf).withColumn("year", F.substring("month", 1, 4)), "year", "month")
    return profile.top(c, ["year"], "month", "n", 1).select("year", "month", "n")


@query("select coalesce(r_name, 'UNMATCHED_ID') as r_name, count(*) as n from customer left join (select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey where n_nationkey <> 3) on c_nationkey = n_nationkey group by 1")
def lookup_join_borough(spark, sf):
    zones = table(spark, sf, "nation").where("n_nationkey <> 3").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return profile.lookup_counts(counts, "c_nationkey", zones, "n_nationkey", "r_name")


@query(f"with {ITEMS} select count(*) as n from (select distinct l_suppkey from items where month = '1997-01') where l_suppkey in (select l_suppkey from items where l_returnflag = 'R')")
def cohort_failed_to_date(spark, sf):
    return profile.cohort_failed(items(spark, sf), "l_suppkey", F.col("month") == "1997-01", F.col("l_returnflag") == "R")


@query(f"with {ITEMS} select count(*) as n from (select distinct l_suppkey from items where month = '1997-01') where l_suppkey in (select l_suppkey from items where month = (select max(month) from items))")
def cohort_present_latest(spark, sf):
    rows = items(spark, sf)
    latest = rows.agg(F.max("month")).first()[0]
    return profile.cohort_failed(rows, "l_suppkey", F.col("month") == "1997-01", F.col("month") == latest)


@query("select event_type, count_if(value is null) as n_null, round_even(count_if(value < 10)::decimal(18,0) / count(*), 5)::decimal(20,5) as small_frac from events group by 1")
def quality_null_frac(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value").isNull()).alias("n_null"), F.count_if(F.col("value") < 10).alias("small"), F.count(F.lit(1)).alias("n"))
    return e.select("event_type", "n_null", scalar.ratio_half_even(F.col("small"), F.col("n"), 5).alias("small_frac"))


@query("select m, round_even(count_if(not (l_shipdate >= date_trunc('month', o_orderdate) and l_shipdate < date_trunc('month', o_orderdate) + interval 1 month))::decimal(18,0) / count(*), 5)::decimal(20,5) as frac from (select strftime(o_orderdate, '%Y-%m') as m, * from lineitem join orders on l_orderkey = o_orderkey) group by 1")
def quality_out_of_partition_frac(spark, sf):
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", scalar.month_of(F.col("o_orderdate")).alias("m")), F.col("l_orderkey") == F.col("o_orderkey"))
    g = j.groupBy("m").agg(F.count_if(scalar.outside_month(F.col("l_shipdate"), F.col("m"))).alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("m", scalar.ratio_half_even(F.col("a"), F.col("b"), 5).alias("frac"))


_C = "cols as (select distinct o_custkey as ds, strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as name from orders)"


def _columns(spark, sf):
    """A customer is a dataset, a month one of its files, and the priorities of its orders are the columns."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("ds"), scalar.month_of(F.col("o_orderdate")).alias("month"), F.col("o_orderpriority").alias("name")).distinct()


@query(f"with {_C} select ds, min(month) filter (where name = '1-URGENT') as first_month, max(month) filter (where name = '1-URGENT') as latest_month, count(distinct month) filter (where name = '1-URGENT') as n_months from cols group by ds")
def coverage_first_month(spark, sf):
    return profile.coverage(_columns(spark, sf), "1-URGENT")


@query(f"with {_C} select ds, coalesce(max(name) filter (where lower(name) = '2-high'), max(name) filter (where lower(name) = '1-urgent')) as \"column\" from cols where lower(name) in ('2-high', '1-urgent') group by ds")
def concept_column(spark, sf):
    return profile.concept(_columns(spark, sf), ["0-none", "2-HIGH", "1-urgent"])


@query("select o_orderstatus, strftime(o_orderdate, '%Y') as year, count(*) as n, grouping(o_orderstatus, strftime(o_orderdate, '%Y'))::bigint as level from orders group by rollup (o_orderstatus, strftime(o_orderdate, '%Y'))")
def rollup_totals(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    return o.rollup("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


@query("select l_returnflag, l_linestatus, sum(round(l_quantity, 2)::decimal(18,2)) as sum_qty, sum(round(l_extendedprice, 2)::decimal(18,2)) filter (where l_discount > 0.05) as sum_discounted, count_if(l_tax = 0) as n_untaxed, count(*) as n from lineitem group by 1, 2")
def filtered_aggregates(spark, sf):
    x = scalar.exact_cents
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(x(F.col("l_quantity"))).alias("sum_qty"),
        F.sum(F.when(F.col("l_discount") > 0.05, x(F.col("l_extendedprice")))).alias("sum_discounted"),
        F.count_if(F.col("l_tax") == 0).alias("n_untaxed"),
        F.count(F.lit(1)).alias("n"),
    )


@query("select event_type, n, n / sum(n) over () as share from (select event_type, count(*) as n from events group by 1)")
def value_frequency(spark, sf):
    c = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("select o_orderpriority, count_if(o_orderstatus = 'F') as f, count_if(o_orderstatus = 'O') as o, count_if(o_orderstatus = 'P') as p from orders group by 1")
def pivot_outcomes(spark, sf):
    p = table(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query(f"with {ITEMS} select max(month) as latest, min(month) as first, count(distinct month) as n_months from items")
def latest_and_first_month(spark, sf):
    return items(spark, sf).agg(F.max("month").alias("latest"), F.min("month").alias("first"), F.countDistinct("month").alias("n_months"))


@query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def outer_join_zero_fill(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("select count(*) as n from (select c_custkey from customer except select o_custkey from orders)")
def set_difference(spark, sf):
    a, b = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select("o_custkey")
    return a.subtract(b).agg(F.count(F.lit(1)).alias("n"))


@query("select count(*) as n from (select distinct c_nationkey from customer intersect select s_nationkey from supplier)")
def set_intersection(spark, sf):
    return table(spark, sf, "customer").select("c_nationkey").intersect(table(spark, sf, "supplier").select("s_nationkey")).agg(F.count(F.lit(1)).alias("n"))
