"""Queries of the snapshot lake: manifests, observations, sampling and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import manifest, observe
from palimpsest.plans.base import FILES, INTERVALS, ITEMS, LOG, files, items, log, query, table
from palimpsest.sources import readers, sinks


@query(f"with {INTERVALS} select * from intervals")
def manifest_fold(spark, sf):
    return manifest.fold(log(spark, sf).select("path", "idx", "sha"))


@query(f"with {INTERVALS} select path, sha from intervals where valid_from <= 40 and (valid_to is null or valid_to > 40)")
def world_at_snapshot(spark, sf):
    return manifest.world(manifest.fold(log(spark, sf).select("path", "idx", "sha")), 40)


@query(f"with {INTERVALS} select i.path, i.sha, s.idx from intervals i join (select distinct idx from log) s on i.valid_from <= s.idx and (i.valid_to is null or i.valid_to > s.idx)")
def worlds_at_all_snapshots(spark, sf):
    changes = log(spark, sf).select("path", "idx", "sha")
    return manifest.worlds(manifest.fold(changes), changes.select("idx").distinct()).select("path", "sha", "idx")


@query(
    f"""with {INTERVALS}, w as (select path, sha from intervals where valid_from <= 40 and (valid_to is null or valid_to > 40)),
    o as (select 'orders/p1/part.parquet' as path, 'new' as sha union all select 'orders/p2/part.parquet', null union all select 'orders/p9/part.parquet', 'more')
    select path, sha from w where path not in (select path from o) union all select path, sha from o where sha is not null"""
)
def overlay_world(spark, sf):
    base = manifest.world(manifest.fold(log(spark, sf).select("path", "idx", "sha")), 40)
    put = spark.sql("select * from values ('orders/p1/part.parquet', 'new'), ('orders/p2/part.parquet', null), ('orders/p9/part.parquet', 'more') as t(path, sha)")
    return manifest.overlay(base, put)


@query(
    f"""with {LOG}, e as (select idx, count(*) as n_paths, count(sha) as n_put, count(*) - count(sha) as n_removed from log group by idx), s as (select *, cast(round(count(*) over () * 0.4::double) as bigint) as s0 from e)
    select printf('lake-%04d', idx) as snapshot, idx - s0 as t, case when idx < s0 then 'history' when idx = s0 then 's0' else 'future' end as phase, n_paths, n_put, n_removed from s"""
)
def snapshot_phases(spark, sf):
    e = log(spark, sf).groupBy(F.col("idx").alias("event")).agg(F.count(F.lit(1)).alias("n_paths"), F.count("sha").alias("n_put"))
    return manifest.number_events(e, "lake", ["event"]).select("snapshot", "t", "phase", "n_paths", "n_put", (F.col("n_paths") - F.col("n_put")).alias("n_removed"))


@query(f"with {LOG} select path, count_if(sha is distinct from before) as n_changes from (select path, sha, lag(sha) over (partition by path order by idx) as before from log) group by path")
def change_frequency(spark, sf):
    return manifest.change_counts(log(spark, sf))


@query(
    f"""with {LOG}, m as (select idx, map_from_entries(list((path, sha)) filter (where sha is not null)) as put, list(path) filter (where sha is null) as gone from log group by idx)
    select idx, coalesce(cardinality(put), 0)::bigint as n_put, coalesce(len(gone), 0)::bigint as n_removed from m"""
)
def monthly_arrival_events(spark, sf):
    """Events put together from changes, then taken apart again."""
    entry = F.collect_list(F.when(F.col("sha").isNotNull(), F.struct("path", "sha")))
    e = log(spark, sf).groupBy("idx").agg(F.map_from_entries(entry).alias("put"), F.collect_list(F.when(F.col("sha").isNull(), F.col("path"))).alias("remove"))
    return manifest.changes(e).groupBy("idx").agg(F.count("sha").alias("n_put"), F.count_if(F.col("sha").isNull()).alias("n_removed"))


@query("select l_orderkey, l_linenumber from lineitem where ('0x' || substr(md5(l_orderkey || ':' || l_linenumber), 1, 8))::bigint % 32 <> 0")
def late_row_holdback(spark, sf):
    return table(spark, sf, "lineitem").where(~scalar.held_back(F.col("l_orderkey"), F.col("l_linenumber"))).select("l_orderkey", "l_linenumber")


@query("select o_orderkey, o_custkey from orders where ('0x' || substr(md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)), 1, 2))::bigint % 64 = 0")
def hash_sample_rows(spark, sf):
    text = F.concat_ws("|", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderstatus")
    return table(spark, sf, "orders").where(scalar.keep_row(text)).select("o_orderkey", "o_custkey")


@query("select o_custkey, count(*) as n from orders where ('0x' || substr(md5(o_custkey::varchar), 15, 2))::bigint % 64 = 0 group by 1")
def hash_sample_keys(spark, sf):
    o = table(spark, sf, "orders").where(scalar.keep_key(F.col("o_custkey").cast("string")))
    return o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {ITEMS}, p as (select month, row_number() over (partition by month order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 as r, count(*) over (partition by month) as n, l_quantity from items)
    select month, case when r < n // 2 then 0 else 1 end as part, count(*) as n, sum(l_quantity) as quantity from p group by 1, 2"""
)
def repartition_halves(spark, sf):
    rows = manifest.split_parts(items(spark, sf), ["month"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])
    return rows.groupBy("month", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query(
    f"""with {FILES} select regexp_replace(path, '\\d+', '#', 'g') as series, max_by(path, list_transform(regexp_extract_all(path, '\\d+'), lambda x: x::bigint)) as newest, count(*) as n_members from files group by 1"""
)
def series_latest_member(spark, sf):
    m = manifest.series_members(files(spark, sf))
    return m.groupBy("series").agg(F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("newest"), F.count(F.lit(1)).alias("n_members"))


@query(
    f"""with {FILES}, w as (select path, case when path like '%-01.parquet' then replace(path, 'lake/', 'moved/') else path end as wanted from files)
    select wanted as path, path as resolved from w"""
)
def resolve_moved_paths(spark, sf):
    f = files(spark, sf)
    moved = F.when(F.col("path").endswith("-01.parquet"), F.replace("path", F.lit("lake/"), F.lit("moved/"))).otherwise(F.col("path"))
    return manifest.resolve_vanished(f.select(moved.alias("path")), f)


@query(f"with {FILES} select split_part(path, '/', 2) || '/' as name, count(*) as n_files from files group by 1")
def ls_dirs(spark, sf):
    return observe.ls(files(spark, sf), "lake")


@query(f"with {FILES} select path from files where regexp_matches(path, '/orders_F_[0-9]{{4}}-0.\\.parquet$')")
def find_glob(spark, sf):
    return observe.find(files(spark, sf), "orders_F_*-0?.parquet")


_LINES = "lines as (select path, row_number_ as line_no, line from (select doc_id::varchar as path, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) as row_number_ from documents))"


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")


@query(f"with {_LINES} select path, line_no::integer as line_no, substr(line, 1, 200) as line from lines where regexp_matches(line, '(?i)licen[sc]e')")
def grep_lines(spark, sf):
    return observe.grep(_texts(spark, sf), "(?i)licen[sc]e")


@query(f"with {_LINES} select path, count(*) as n_lines from lines where regexp_matches(line, 'the ') group by 1")
def grep_count(spark, sf):
    return observe.grep_count(_texts(spark, sf), "the ")


@query(f"with {_LINES} select line_no::integer as line_no, line from lines where path = '7' and line_no between 2 and 5")
def read_text_span(spark, sf):
    return observe.read_text(_texts(spark, sf), "7", 2, 5)


@query("select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 20")
def head_rows(spark, sf):
    return observe.head(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], 50)


@query(
    """select 'l_orderkey' as "column", min(l_orderkey)::varchar as min, max(l_orderkey)::varchar as max, count(*) - count(l_orderkey) as null_count, count(*) as n_rows from lineitem
    union all select 'l_returnflag', min(l_returnflag), max(l_returnflag), count(*) - count(l_returnflag), count(*) from lineitem"""
)
def file_stats(spark, sf):
    return observe.stats(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"])


@query("select 'orders' as file, count(*) as n_rows from orders union all select 'lineitem', count(*) from lineitem union all select 'events', count(*) from events")
def file_rowcount(spark, sf):
    count = lambda n: table(spark, sf, n).agg(F.lit(n).alias("file"), F.count(F.lit(1)).alias("n_rows"))
    return count("orders").unionByName(count("lineitem")).unionByName(count("events"))


@query(
    """with t as (select * from (values ('BIGINT', 'bigint'), ('VARCHAR', 'string'), ('DOUBLE', 'double'), ('TIMESTAMP', 'timestamp_ntz'), ('INTEGER', 'int')) v(d, s))
    select (row_number() over (order by column_index) - 1)::integer as pos, column_name as name, t.s as type from duckdb_columns() c join t on c.data_type = t.d where table_name = 'orders'"""
)
def file_schema(spark, sf):
    return readers.file_columns(spark, f"{sf}/orders.parquet")


_TYPES = "t as (select * from (values ('BIGINT', 'bigint'), ('VARCHAR', 'string'), ('DOUBLE', 'double'), ('TIMESTAMP', 'timestamp_ntz'), ('INTEGER', 'int'), ('FLOAT', 'float'), ('FLOAT[]', 'array<float>'), ('DOUBLE[]', 'array<double>')) v(d, s))"


@query(
    f"""with {_TYPES}, c as (select table_name as f, column_index as i, regexp_replace(column_name, '^[a-z]+_', '') as name, t.s as type from duckdb_columns() join t on data_type = t.d where table_name in ('customer', 'supplier')),
    a as (select name, type from c where f = 'customer'), b as (select case when name = 'name' then 'Name' else name end as name, type from c where f = 'supplier')
    select coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' when a.name <> b.name then 'renamed' else 'retyped' end as change, a.type as old_type, b.type as new_type
    from a full join b on lower(a.name) = lower(b.name) where a.name is distinct from b.name or a.type <> b.type"""
)
def schema_diff(spark, sf):
    """The columns of two files, without their prefixes."""
    bare = F.regexp_replace("name", "^[a-z]+_", "")
    a = readers.file_columns(spark, f"{sf}/customer.parquet").withColumn("name", bare)
    b = readers.file_columns(spark, f"{sf}/supplier.parquet").withColumn("name", bare)
    return observe.schema_diff(a, b.withColumn("name", F.when(F.col("name") == "name", "Name").otherwise(F.col("name"))))


@query(
    """with c as (select table_name as f, column_index as i, regexp_replace(column_name, '^[a-z]+_', '') as name from duckdb_columns() where table_name in ('customer', 'supplier')),
    j as (select a.i as i, b.i as k from c a join c b on a.name = b.name and a.f = 'customer' and b.f = 'supplier'), r as (select row_number() over (order by i) as x, row_number() over (order by k) as y from j)
    select count(*) as n_shared, coalesce(bool_and(x = y), true) as same_order from r"""
)
def schema_order(spark, sf):
    """Whether the columns that two files share stand in the same order."""
    bare = F.regexp_replace("name", "^[a-z]+_", "")
    a = readers.file_columns(spark, f"{sf}/customer.parquet").withColumn("name", bare)
    b = readers.file_columns(spark, f"{sf}/supplier.parquet").withColumn("name", bare)
    return observe.same_order(a, b)


@query(
    """with n as (select distinct o_orderdate::date as day, o_orderpriority as name, max(o_orderstatus) as type from orders group by 1, 2),
    d as (select distinct day, dense_rank() over (order by day) as i from n),
    a as (select d.i, d.day, n.name, n.type from n join d using (day)),
    j as (select coalesce(x.day, e.day) as day, coalesce(x.name, y.name) as name, x.type as now, y.type as before from a x full join a y on x.i = y.i + 1 and x.name = y.name left join d e on e.i = y.i + 1)
    select day, coalesce(string_agg(name, ',' order by name) filter (where before is null), '') as added, coalesce(string_agg(name, ',' order by name) filter (where now is null), '') as removed, coalesce(string_agg(name, ',' order by name) filter (where now <> before), '') as retyped
    from j where day is not null and day > (select min(day) from n) and now is distinct from before group by day"""
)
def schema_timeline(spark, sf):
    """Days whose columns differ from the day before: priorities are names, their greatest status is the type."""
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("name")).agg(F.max("o_orderstatus").alias("type"))
    return manifest.schema_changes(o, "day")


@query("select o_orderstatus, count(*) as n, sum(round(o_totalprice, 2)::decimal(18,2)) as total from orders where o_totalprice > 1000 group by 1 order by n desc, 1 limit 51")
def guarded_select(spark, sf):
    rows, _ = observe.guarded_sql(
        spark,
        "SELECT o_orderstatus, count(*) AS n, sum(cast(round(o_totalprice, 2) AS decimal(28,2))) AS total FROM 'orders.parquet' WHERE o_totalprice > 1000 GROUP BY 1 ORDER BY n DESC, 1",
        {"orders.parquet": table(spark, sf, "orders")},
        {"orders.parquet": table(spark, sf, "orders").count()},
        most_rows=10**15,  # the whole table, whatever its size
    )
    return rows


@query("select page_id, length(html) > 0 as has_html from pages")
def page_presence(spark, sf):
    return table(spark, sf, "pages").select("page_id", (F.length("html") > 0).alias("has_html"))


_V = r"""
  select page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<noscript\b.*?</noscript>|<svg\b.*?</svg>|<head\b.*?</head>', ' ', 'g'),
      '(?s)<!--.*?-->', ' ', 'g'), '(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)\b[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\r\x0b\x0c]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g') as text
  from pages"""


@query(_V)
def html_visible_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalar.visible_text(F.col("html")).alias("text"))


@query(
    """select doc_id from (select doc_id, row_number() over (partition by source, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) order by doc_id) as r from documents) where r = 1"""
)
def document_versions_dedup(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("arrival"), "text")
    return readers.first_versions(d).select(F.col("arrival").alias("doc_id"))


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'new' else o_orderstatus end as status from orders")
def merge_by_key(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return sinks.merge_by_key(o, o.where("o_orderkey % 5 = 0").withColumn("status", F.lit("new")), ["o_orderkey"])


@query("select event_id, json_extract(props, '$.k')::bigint as k, substr(sha256(props), 1, 16) as key from events")
def json_arg_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.substring(F.sha2("props", 256), 1, 16).alias("key"))


@query(
    """select o_orderkey, case when o_orderstatus = 'P' then 'NONE' when o_orderstatus = 'F' then round_even(o_totalprice::decimal(18,2), 1)::decimal(18,1)::varchar
      when o_orderpriority = '1-URGENT' then o_orderkey::varchar else o_orderpriority || ', ' || o_custkey end as answer from orders"""
)
def canonical_answers(spark, sf):
    """Answers as they are written by hand: quoted, with a unit, as a list without blanks."""
    o, urgent = table(spark, sf, "orders"), F.col("o_orderpriority") == "1-URGENT"
    kind = lambda none, number, whole, listed: F.when(F.col("o_orderstatus") == "P", none).when(F.col("o_orderstatus") == "F", number).when(urgent, whole).otherwise(listed)
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    given = kind(F.lit("`none`"), F.concat(F.lit('"'), price, F.lit('"')), F.concat(F.lit("about "), F.format_number("o_orderkey", 0), F.lit(" rows")), F.concat_ws(",", "o_orderpriority", F.col("o_custkey").cast("string")))
    known = kind(F.lit("7"), F.lit("2.7"), F.lit("99"), F.lit("c, d"))
    return o.select("o_orderkey", scalar.canonical_answer(given, known).alias("answer"))


@query(
    f"""with {FILES}, c as (select distinct user_id as iid, case event_type when 'click' then 'lake/1995/' when 'view' then 'orders_F_*-0?.parquet' when 'signup' then 'lake/**/orders_P_*.parquet' else 'lake/1996/orders_O_1996-03.parquet' end as item from events)
    select distinct iid, path from c join files on case when item like '%/' then starts_with(path, item) when item = path then true
      when item = 'orders_F_*-0?.parquet' then regexp_matches(path, '/orders_F_[^/]*-0.\\.parquet$') when item like '%**%' then regexp_matches(path, '^lake/.*orders_P_.*\\.parquet$') else false end"""
)
def read_sets(spark, sf):
    """The files that each key's calls read: a folder, two shell patterns, a path."""
    kind = F.col("event_type")
    item = F.when(kind == "click", "lake/1995/").when(kind == "view", "orders_F_*-0?.parquet").when(kind == "signup", "lake/**/orders_P_*.parquet").otherwise("lake/1996/orders_O_1996-03.parquet")
    calls = table(spark, sf, "events").select(F.col("user_id").alias("iid"), item.alias("item")).distinct()
    return observe.read_set(calls, files(spark, sf))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso, epoch_us(ts) as micros, (date_trunc('month', ts) + interval 1 month)::date as next_month from events")
def date_texts(spark, sf):
    e = table(spark, sf, "events")
    next_month = F.add_months(F.to_date(F.concat(scalar.month_of(F.col("ts")), F.lit("-01"))), 1)
    return e.select("event_id", scalar.iso_text(F.col("ts")).alias("iso"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), next_month.alias("next_month"))


@query("select event_id, json_extract_string(props, '$.k') as k, 'NONE' as gone, '{\"a\":\"' || event_type || '\",\"k\":\"' || json_extract_string(props, '$.k') || '\"}' as sorted from events")
def json_objects(spark, sf):
    """The first object of a text, a missing key, and an object with its keys in order."""
    e = table(spark, sf, "events")
    text = F.concat(F.lit("the answer is "), "props", F.lit(' and not {"k": 0}'))
    loose = F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "a": "'), "event_type", F.lit('"}'))
    return e.select("event_id", scalar.first_object(text, "k").alias("k"), scalar.first_object(text, "q").alias("gone"), scalar.sorted_json(loose).alias("sorted"))
