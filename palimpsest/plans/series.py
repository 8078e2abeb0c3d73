"""Queries of partition series: exact dependencies, facts at every snapshot, versions side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import evidence, inference, manifest, profile, records
from palimpsest.plans.base import FILES, INTERVALS, ITEMS, LOG, files, items, log, query, table
from palimpsest.sources import readers, sinks

PATTERN = r"^lake/\d{4}/orders_([A-Z])_(\d{4}-\d{2})\.parquet$"
INDEX = FILES + ", parts as (select split_part(path, '_', 2) as ds, substr(path, length(path) - 14, 7) as month, path from files)"


def _index(spark, sf):
    return manifest.partition_index(files(spark, sf), PATTERN)


@query(f"with {INDEX} select ds, month, string_agg(path, ',' order by path) as paths from parts group by 1, 2")
def partition_index(spark, sf):
    return _index(spark, sf).withColumn("paths", F.array_join("paths", ","))


@query(f"with {INDEX} select ds, month, path from parts where ds = 'F' and month like '1995%' union all select ds, month, path from parts where ds = 'O' and month = '1998-03' union all select ds, month, path from parts where ds = 'P'")
def period_parts(spark, sf):
    index = _index(spark, sf)
    return manifest.period_parts(index, "F", "1995").union(manifest.period_parts(index, "O", "1998-03")).union(manifest.period_parts(index, "P", "all"))


@query(f"with {INDEX}, l as (select ds, max(month) as month from parts group by 1) select ds, month, string_agg(path, ',' order by path) as paths from parts join l using (ds, month) group by 1, 2")
def latest_parts(spark, sf):
    return manifest.latest_parts(_index(spark, sf)).withColumn("paths", F.array_join("paths", ","))


# each part arrives with its month, and a December part is corrected (gets new content) a month later
_PARTS = """o as (select o_orderstatus as ds, strftime(o_orderdate, '%Y-%m') as month, o_totalprice from orders), ms as (select month, row_number() over (order by month) - 1 as idx from (select distinct month from o)),
  pr as (select ds, month, count(*) as n, sum(round(o_totalprice, 2)::decimal(18,2)) as total from o group by 1, 2), fs as (select distinct ds, substr(month, 1, 4) as period from pr union select distinct ds, 'all' from pr),
  facts as (select ds || ':' || period as fact, ds, period from fs)"""
SERIES = _PARTS + """, w as (select s.idx, p.ds, p.month, p.n, p.total, 'lake/' || substr(p.month, 1, 4) || '/orders_' || p.ds || '_' || p.month || '.parquet' as path, case when p.month like '%-12' and s.idx > a.idx then 'c' else 'a' end as v
    from pr p join ms a using (month) join ms s on a.idx <= s.idx),
  series as (select f.fact, w.idx, sum(n)::bigint as n, sum(total) as total, substr(sha1(string_agg(path || '=' || md5(path || v), chr(30) order by path)), 1, 16) as dep
    from facts f join w on f.ds = w.ds and (f.period = 'all' or w.month like f.period || '%') group by 1, 2)"""


def _series(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ds"), scalar.month_of(F.col("o_orderdate")).alias("month"), "o_totalprice")
    parts = o.groupBy("ds", "month").agg(F.count(F.lit(1)).alias("n"), F.sum(scalar.exact_cents(F.col("o_totalprice"))).alias("total"))
    path = F.concat(F.lit("lake/"), F.substring("month", 1, 4), F.lit("/orders_"), "ds", F.lit("_"), "month", F.lit(".parquet"))
    snapshots = inference.numbered(o.select("month").distinct(), "month", "idx")
    first = parts.join(snapshots, "month").select("ds", "month", path.alias("path"), "idx", F.lit("a").alias("v"))
    again = first.where(F.col("month").endswith("-12")).withColumn("idx", F.col("idx") + 1).withColumn("v", F.lit("c"))
    changes = first.unionByName(again.join(snapshots.select("idx"), "idx", "left_semi").select(first.columns)).withColumn("sha", F.md5(F.concat("path", "v")))
    worlds = manifest.worlds(manifest.fold(changes.select("path", "idx", "sha")), snapshots.select("idx"))
    named = worlds.select("idx", "path", "sha", F.regexp_extract("path", PATTERN, 1).alias("ds"), F.regexp_extract("path", PATTERN, 2).alias("month"))
    versions = changes.join(parts, ["ds", "month"]).select("sha", "n", "total")
    ds = parts.select("ds", F.explode(F.array(F.substring("month", 1, 4), F.lit("all"))).alias("period")).distinct()
    facts = ds.select(F.concat_ws(":", "ds", "period").alias("fact"), "ds", "period")
    return profile.fact_series(facts, named, versions, ["n", "total"])


@query(f"with {SERIES} select fact, idx, n, total, dep, row_number() over (partition by fact, dep order by idx) = 1 as evaluate from series")
def facts_at_snapshots(spark, sf):
    """Every fact (status and year, or all years) at every month's snapshot, evaluated once per dependency set."""
    return _series(spark, sf)


@query(f"with {SERIES}, p as (select split_part(fact, ':', 1) as type, fact, count(distinct n) as k from series group by 1, 2) select type, count(*) as n_facts, count_if(k > 1) / count(*) as changing, avg(k) as mean_values from p group by 1")
def base_rates(spark, sf):
    return profile.base_rates(_series(spark, sf).withColumn("type", F.substring_index("fact", ":", 1)), "n")


_DIRECT = "with o as (select o_orderstatus as ds, strftime(o_orderdate, '%Y') as year, o_totalprice from orders) select ds || ':' || coalesce(year, 'all') as fact, count(*) as n, sum(round(o_totalprice, 2)::decimal(18,2)) as total from o group by grouping sets ((ds, year), (ds))"


@query(_DIRECT)
def facts_direct(spark, sf):
    """The facts at the last snapshot from the rows themselves: the twin of the last rows of facts_at_snapshots."""
    o = table(spark, sf, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    return o.groupingSets([["o_orderstatus", "year"], ["o_orderstatus"]], "o_orderstatus", "year").agg(F.concat_ws(":", "o_orderstatus", F.coalesce("year", F.lit("all"))).alias("fact"), F.count(F.lit(1)).alias("n"), F.sum(scalar.exact_cents(F.col("o_totalprice"))).alias("total")).select("fact", "n", "total")


@query(f"with {SERIES}, l as (select * from series where idx = (select max(idx) from ms)), d as ({_DIRECT}) select count(*) as n_facts, count_if(l.n = d.n and l.total = d.total) as n_equal from l join d using (fact)")
def oracle_validation(spark, sf):
    """Facts through profiles against facts from rows, at the last snapshot."""
    s = _series(spark, sf)
    last = s.join(F.broadcast(s.agg(F.max("idx").alias("idx"))), "idx")  # one row
    d = facts_direct(spark, sf).select("fact", F.col("n").alias("dn"), F.col("total").alias("dtotal"))
    return last.join(d, "fact").agg(F.count(F.lit(1)).alias("n_facts"), F.count_if((F.col("n") == F.col("dn")) & (F.col("total") == F.col("dtotal"))).alias("n_equal"))


@query(f"with {_PARTS} select distinct f.fact from facts f join pr on pr.ds = f.ds and (f.period = 'all' or pr.month like f.period || '%') where pr.month like '%-12'")
def touched_facts(spark, sf):
    """Facts whose files a correction of the December parts touches."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ds"), scalar.month_of(F.col("o_orderdate")).alias("month")).distinct()
    ds = o.select("ds", F.explode(F.array(F.substring("month", 1, 4), F.lit("all"))).alias("period")).distinct()
    facts = ds.select(F.concat_ws(":", "ds", "period").alias("fact"), "ds", "period")
    return manifest.relevant(facts, o.where(F.col("month").endswith("-12"))).select("fact").distinct()


@query(f"with {INTERVALS}, w as (select path, sha from intervals where valid_from <= 40 and (valid_to is null or valid_to > 40)) select replace(path, 'orders/', 'sales/') as path, 41::bigint as idx, sha from w union all select path, 41, null from w")
def renamed_folder(spark, sf):
    return manifest.rename(manifest.world(manifest.fold(log(spark, sf).select("path", "idx", "sha")), 40), "orders/", "sales/", 41)


@query("select source as path, coalesce(max(doc_id) filter (where doc_id <= 500), min(doc_id)) as arrival, coalesce(max_by(md5(text), doc_id) filter (where doc_id <= 500), min_by(md5(text), doc_id)) as sha from documents group by 1")
def bootstrap_versions(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("arrival"), F.md5("text").alias("sha"))
    return manifest.bootstrap_versions(d, F.lit(500))


@query(
    f"""with {LOG}, f as (select path, max_by(sha, idx) as final, max(idx) as upto from log where month like '%-12' group by path)
    select l.path, l.idx, case when l.idx < f.upto and l.sha is not null then f.final else l.sha end as sha from log l left join f using (path) where l.month not like '%-12'"""
)
def real_only_log(spark, sf):
    """December's replacements are taken for synthetic ones."""
    return manifest.real_only(log(spark, sf).select("path", "idx", "sha", F.col("month").endswith("-12").alias("synthetic")))


@query(f"with {INTERVALS}, a as (select path, sha from intervals where valid_from <= 20 and (valid_to is null or valid_to > 20)), b as (select path, sha from intervals where valid_from <= 60 and (valid_to is null or valid_to > 60)) select coalesce(a.path, b.path) as path, a.sha as old, b.sha as new from a full join b on a.path = b.path")
def two_versions(spark, sf):
    return manifest.two_versions(manifest.fold(log(spark, sf).select("path", "idx", "sha")), 20, 60)


@query("select strftime(l_shipdate, '%Y-%m') as month, count(*) as n, count_if(l_returnflag = 'R') as failures, count(distinct l_suppkey) as n_serials, count(distinct l_linenumber) as n_models, count(l_discount) as n_capacity, count_if(l_discount < 0) as neg_capacity, sum(round(l_discount, 2)::decimal(18,2)) as sum_capacity from lineitem group by 1")
def entity_profile(spark, sf):
    return profile.entity_profile(items(spark, sf), "month", "l_suppkey", "l_linenumber", F.col("l_returnflag") == "R", "l_discount")


@query(f"with {ITEMS} select l_linenumber as model, count(distinct l_suppkey) as n_serials, count_if(l_returnflag = 'R') as failures from items group by 1")
def model_serials(spark, sf):
    return items(spark, sf).groupBy(F.col("l_linenumber").alias("model")).agg(F.countDistinct("l_suppkey").alias("n_serials"), F.count_if(F.col("l_returnflag") == "R").alias("failures"))


@query(f"with {ITEMS}, c as (select distinct l_suppkey, l_returnflag from items where month = '1997-01') select count(*) as n from c where (l_suppkey, l_returnflag) in (select (l_suppkey, l_returnflag) from items where month = (select max(month) from items))")
def cohort_same_model(spark, sf):
    """Members of a month's cohort that are there in the last month with the same model (return flag)."""
    rows = items(spark, sf).select("l_suppkey", "l_returnflag", "month")
    last = F.broadcast(rows.agg(F.max("month").alias("month")))  # one row
    keys = ["l_suppkey", "l_returnflag"]
    return rows.where("month = '1997-01'").select(*keys).distinct().join(rows.join(last, "month").select(*keys), keys, "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with g as (select event_type, count(*)::decimal(18,0) as b, count_if(value is null) as nul, count_if(value < 0) as neg, count_if(value = 0) as zer from events group by 1)
    select event_type, 'null' as "check", round_even(nul / b, 5)::decimal(20,5)::varchar as answer from g union all select event_type, 'neg', round_even(neg / b, 5)::decimal(20,5)::varchar from g
    union all select event_type, 'zero', round_even(zer / b, 5)::decimal(20,5)::varchar from g union all select event_type, 'absent null', '1.00000' from g union all select event_type, 'absent neg', '0.00000' from g"""
)
def quality_fractions(spark, sf):
    e = table(spark, sf, "events")
    one = lambda check, column, name: profile.quality_fraction(e, "event_type", check, column).withColumn("check", F.lit(name))
    out = one("null", "value", "null").unionByName(one("neg", "value", "neg")).unionByName(one("zero", "value", "zero"))
    return out.unionByName(one("null", "fee", "absent null")).unionByName(one("neg", "fee", "absent neg")).select("event_type", "check", "answer")


@query(f"with {LOG} select path, count(*) as n_files, sum(n)::bigint as n_rows from log where sha is not null group by rollup (path)")
def catalogue_rollup(spark, sf):
    """Files and rows of each dataset, and the total row (null)."""
    return log(spark, sf).where("sha is not null").rollup("path").agg(F.count(F.lit(1)).alias("n_files"), F.sum("n").alias("n_rows"))


@query("select o_orderpriority, o_orderstatus, count(*) as n, sum(round(o_totalprice, 2)::decimal(18,2)) as total from orders group by cube (o_orderpriority, o_orderstatus)")
def cube_totals(spark, sf):
    return table(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum(scalar.exact_cents(F.col("o_totalprice"))).alias("total"))


@query()
def approximate_distinct(spark, sf):
    """An approximate distinct count beside the exact one; a test holds them within 5 %."""
    return table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_suppkey", 0.01).alias("approximate"), F.countDistinct("l_suppkey").alias("exact"))


@query("select o_orderpriority as stratum, o_orderkey, n from (select o_orderpriority, o_orderkey, row_number() over (partition by o_orderpriority order by md5('sample|' || o_orderkey), o_orderkey) as n from orders) where n <= 30")
def stratified_sample(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), "o_orderkey")
    return inference.stratified_sample(o, "stratum", "o_orderkey", 30, "sample")


@query("""select 'lineitem' as file, count(*) as n, sum(round(l_extendedprice, 2)::decimal(18,2)) as price, count(l_linenumber) as n_number, count(distinct l_returnflag) as n_flags from lineitem
    union all select 'orders', count(*), sum(round(o_totalprice, 2)::decimal(18,2)), 0, count(distinct o_orderstatus) from orders""")
def drifting_schemas(spark, sf):
    """Files whose columns differ in name, type and presence, read as one table of concepts."""
    concepts = {"price": ("double", ["total", "O_TOTALPRICE", "l_extendedprice"]), "flag": ("string", ["o_orderstatus", "l_returnflag"]), "number": ("int", ["l_linenumber", "o_orderpriority"])}
    one = lambda name: readers.read_drifting(spark, [f"{sf}/{name}.parquet"], concepts).drop("file").withColumn("file", F.lit(name))
    rows = one("orders").unionByName(one("lineitem"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(scalar.exact_cents(F.col("price"))).alias("price"), F.count("number").alias("n_number"), F.countDistinct("flag").alias("n_flags"))


@query("select c_custkey, coalesce(o.n, c_nationkey::bigint) as value from customer left join (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1) o on o_custkey = c_custkey")
def fill_missing(spark, sf):
    """A merge that fills only the cells without a value."""
    p = table(spark, sf, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("value"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("value"))
    return sinks.fill_missing(p.join(c.select("c_custkey"), "c_custkey", "left_semi"), c, ["c_custkey"], "value")


@query("select n_nationkey::bigint as code, n_name from nation where n_nationkey > 4")
def lookup_rows(spark, sf):
    """Rows of a lookup with whole-number keys; others (here x0 to x4) are no keys."""
    n = table(spark, sf, "nation").select(F.when(F.col("n_nationkey") > 4, F.col("n_nationkey").cast("string")).otherwise(F.concat(F.lit("x"), "n_nationkey")).alias("code"), "n_name")
    return readers.read_lookup(n, "code", ["n_name"])


@query(
    """with o as (select o_custkey, o_orderstatus from orders), moved as (select o_custkey, o_orderstatus from orders order by o_totalprice), few as (select distinct * from o)
    select not exists (from (from o except all from moved)) and not exists (from (from moved except all from o)) as same, not exists (from (from o except all from few)) and not exists (from (from few except all from o)) as differs"""
)
def bag_equality(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    return spark.range(1).select(F.lit(manifest.same_rows(o, o.repartition(7))).alias("same"), F.lit(manifest.same_rows(o, o.distinct())).alias("differs"))


@query(
    """with found as (select 'customer' as path, count(*) as n from customer union all select 'nation', count(*) from nation union all select 'region', count(*) from region union all select 'supplier', count(*) from supplier),
    known as (select path, case when path = 'region' then n + 1 else n end as n from found where path <> 'supplier')
    select f.path, f.n as n_rows, case when k.n is null then 'unknown' when f.n <> k.n then 'rows differ' else 'ok' end as verdict from found f left join known k using (path)"""
)
def verify_sources(spark, sf):
    """Recomputed row counts and schemas against a catalogue that tells one wrong count and lacks one file."""
    names = ["customer", "nation", "region", "supplier"]
    found = sinks.describe_sources(spark, {n: f"{sf}/{n}.parquet" for n in names})
    known = found.where("path <> 'supplier'").withColumn("n_rows", F.when(F.col("path") == "region", F.col("n_rows") + 1).otherwise(F.col("n_rows")))
    return sinks.verify_sources(known, found).select("path", "n_rows", "verdict")


@query("select 'orders' as file, count(*) as n_rows, min(o_orderkey)::varchar as lo, max(o_orderkey)::varchar as hi, 0::bigint as nulls from orders union all select 'lineitem', count(*), min(l_orderkey)::varchar, max(l_orderkey)::varchar, 0 from lineitem")
def footer_statistics(spark, sf):
    """Rows, extremes and nulls of a column from footers alone, on any file system that Spark reads."""
    one = lambda n, c: readers.footers(spark, f"{sf}/{n}.parquet", c).select(F.lit(n).alias("file"), "n_rows", "lo", "hi", "nulls")
    return one("orders", "o_orderkey").unionByName(one("lineitem", "l_orderkey"))


@query("select distinct strftime(o_orderdate, '%Y-%m') as month, (date_trunc('month', o_orderdate) + interval 2 month + interval 14 day)::date as monthly, (date_trunc('month', o_orderdate) + interval 1 month)::date as daily from orders")
def release_calendar(spark, sf):
    """When a month comes out: on the 15th of the month after next, or on the first of the next."""
    m = table(spark, sf, "orders").select(scalar.month_of(F.col("o_orderdate")).alias("month")).distinct()
    return m.select("month", manifest.release_date(F.col("month"), 2, 15).alias("monthly"), manifest.release_date(F.col("month"), 1, 1).alias("daily"))


@query("select user_id::varchar as path, year(ts)::integer as year, min(ts) as arrival, min_by(props, ts) as text from events group by 1, 2")
def first_captures(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), F.col("ts").alias("arrival"), F.col("props").alias("text"))
    return readers.first_captures(e)


_NEWEST = _PARTS + """, fw as (select s.idx, 'lake/' || substr(p.month, 1, 4) || '/orders_' || p.ds || '_' || p.month || '.parquet' as path from pr p join ms a using (month) join ms s on a.idx <= s.idx),
  newest as (select idx, regexp_replace(path, '\\d+', '#', 'g') as series, max(path) as path, count(*) as n_members from fw group by 1, 2)"""


def _files_by_snapshot(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ds"), scalar.month_of(F.col("o_orderdate")).alias("month")).distinct()
    snapshots = inference.numbered(o.select("month").distinct(), "month", "idx")
    path = F.concat(F.lit("lake/"), F.substring("month", 1, 4), F.lit("/orders_"), "ds", F.lit("_"), "month", F.lit(".parquet"))
    changes = o.join(snapshots, "month").select(path.alias("path"), "idx", F.md5(path).alias("sha"))
    return manifest.worlds(manifest.fold(changes), snapshots.select("idx"))


@query(f"with {_NEWEST} select * from newest")
def newest_members(spark, sf):
    """The role "newest file of a series", resolved at every snapshot."""
    return manifest.newest(_files_by_snapshot(spark, sf))


@query(f"with {_NEWEST} select n.idx, n.series, pr.n as n_rows from newest n join pr on n.path = 'lake/' || substr(pr.month, 1, 4) || '/orders_' || pr.ds || '_' || pr.month || '.parquet'")
def observed_newest(spark, sf):
    """What an anchored row count observes at every snapshot: each file version is counted once."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("ds"), scalar.month_of(F.col("o_orderdate")).alias("month"))
    path = F.concat(F.lit("lake/"), F.substring("month", 1, 4), F.lit("/orders_"), "ds", F.lit("_"), "month", F.lit(".parquet"))
    counts = o.groupBy("ds", "month").agg(F.count(F.lit(1)).alias("n_rows")).select(path.alias("path"), "n_rows")
    return manifest.newest(_files_by_snapshot(spark, sf)).join(counts, "path").select("idx", "series", "n_rows")


@query(
    f"""with {_NEWEST}, l as (select * from newest where idx = (select max(idx) from ms)), c as (select o_custkey as iid, o_orderkey as pos, 'lake/' || strftime(o_orderdate, '%Y') || '/orders_' || o_orderstatus || '_' || strftime(o_orderdate, '%Y-%m') || '.parquet' as path from orders)
    select iid, 'head ' || case when l.path is not null then 'newest ' || l.series else 'path ' || c.path end as query, min(pos) as pos from c left join l on c.path = l.path group by 1, 2"""
)
def anchored_calls(spark, sf):
    """Calls on files as queries that survive drift, without repeats."""
    path = F.concat(F.lit("lake/"), F.date_format("o_orderdate", "yyyy"), F.lit("/orders_"), "o_orderstatus", F.lit("_"), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".parquet"))
    calls = table(spark, sf, "orders").select(F.col("o_custkey").alias("iid"), F.col("o_orderkey").alias("pos"), F.lit("head").alias("tool"), path.alias("path"))
    n = manifest.newest(_files_by_snapshot(spark, sf))
    return evidence.anchor_calls(calls, n.join(F.broadcast(n.agg(F.max("idx").alias("idx"))), "idx"))  # one row


@query(f"with {FILES} select path, case when path like '%_1997-03.parquet' then 'lake/1997/orders_' || split_part(path, '_', 2) || '_1997-03.parquet' when path like 'lake/1997/%' then 'lake/1997/orders_' || split_part(path, '_', 2) || '_1997-#.parquet' else 'lake/#/orders_' || split_part(path, '_', 2) || '_#-#.parquet' end as series from files")
def question_series(spark, sf):
    """Series as narrow as a question about March 1997 makes them."""
    return files(spark, sf).select("path", manifest.named_series(F.col("path"), F.lit("How many orders of 1997 came by 1997-03?")).alias("series"))


@query(
    f"""with {INTERVALS}, worlds as (select i.path, i.sha, s.idx from intervals i join (select distinct idx from log) s on i.valid_from <= s.idx and (i.valid_to is null or i.valid_to > s.idx))
    select idx, substr(sha1(string_agg(path || '=' || sha, chr(30) order by path)), 1, 16) as filehash, substr(sha1(string_agg(path, chr(30) order by path)), 1, 16) as manifest from worlds group by idx"""
)
def guard_states(spark, sf):
    changes = log(spark, sf).select("path", "idx", "sha")
    return evidence.guard_states(manifest.worlds(manifest.fold(changes), changes.select("idx").distinct()))


@query("select doc_id, case when length(text) <= 12288 then 'single' when length(text) // 2 <= 20480 then 'hierarchical' else 'too_large' end as plan from documents where text is not null")
def verdict_plans(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    return d.select("doc_id", evidence.verdict_plan(F.length("text"), F.floor(F.length("text") / 2)).alias("plan"))


@query("select user_id % 10 as repo, count(*) as n, count_if(event_type = 'error') as fail, count_if(event_type <> 'error' and event_id % 4 <> 0) as success, count_if(event_type <> 'error' and event_id % 4 = 0) as wrong from events group by 1")
def task_checks(spark, sf):
    """Answers to tasks, quoted, some of them wrong or missing, against the truth."""
    e = table(spark, sf, "events")
    truth = F.col("event_id").cast("string")
    given = F.when(F.col("event_type") == "error", F.lit(None)).when(F.col("event_id") % 4 == 0, (F.col("event_id") + 1).cast("string")).otherwise(F.concat(F.lit('"'), truth, F.lit('"')))
    rows = e.select((F.col("user_id") % 10).alias("repo"), records.task_check(given, truth).alias("outcome"))
    return rows.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("outcome") == x).alias(x) for x in ("fail", "success", "wrong")])
