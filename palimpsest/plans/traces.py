"""Queries of anchored traces, observations at every snapshot, and spans carried over versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import spans, steps, traces
from palimpsest.plans.base import FILES, files, query, table
from palimpsest.plans.snapshots import LAKE, _lake

#: A trace is what a user did within eight days: listings, searches, statements and calls on files.
_CALLS = f"""{FILES}, e as (
    select *, user_id || '-' || (day(ts) // 8) as iid, (1995 + event_id % 7)::varchar as y, substr('FOP', (1 + event_id % 3)::int, 1) as ds, lpad((1 + event_id // 7 % 12)::varchar, 2, '0') as mm from events),
  f as (select *, 'lake/' || y || '/orders_' || ds || '_' || y || '-' || mm || '.parquet' as file from e),
  c0 as (select iid, event_id as pos,
    case event_type when 'view' then 'ls' when 'click' then 'find' when 'purchase' then 'file_stats' when 'signup' then 'sql' else 'file_rowcount' end as tool,
    case event_type when 'view' then case when event_id % 5 = 0 then 'lake' else 'lake/' || y end when 'click' then 'lake/' || y || '/orders_' || ds || '_*.parquet'
      when 'purchase' then file when 'signup' then null else 'lake/2001/orders_' || ds || '_2001-08.parquet' end as path,
    case when event_type = 'signup' then 'select count(*) from ''' || case when event_id % 2 = 0 then file else 'orders_' || ds || '_' || y || '-0?.parquet' end || '''' end as text from f),
  c as (select iid, tool, path, text, min(pos) as pos from c0 group by 1, 2, 3, 4),
  facts as (select distinct iid, case when user_id % 3 = 0 then 'How many orders of 1997?' else 'Which month is the newest?' end as question, case user_id % 4 when 0 then '12' when 1 then '1998-03' when 2 then '3' end as answer from e)"""
_LOOSE = "regexp_replace({0}, '\\d+', '#', 'g')"
_ANCHORS = f"""with {_CALLS},
  raw as (select iid, pos, tool, unnest([path] || regexp_extract_all(coalesce(text, ''), '''([^'']*)''', 1)) as bare from c),
  named as (select *, string_split(bare, '/') as parts from raw where bare is not null),
  refs as (select distinct iid, pos, unnest([case when tool = 'ls' then bare || '/' else bare end] || list_transform(range(1, len(parts)), lambda i: array_to_string(parts[:i], '/') || '/')) as item from named),
  globs as (select *, '^' || replace(replace(replace(item, '.', '\\.'), '*', '.*'), '?', '.') || '$' as rx from refs where regexp_matches(item, '[*?]')),
  newest as (select {_LOOSE.format("path")} as series, max(path) as file, count(*) as n from files group by 1),
  told as (select c.*, n.series, n.series is not null and n.n >= 2 and not exists (select 1 from globs g where g.iid = c.iid and regexp_matches(g.item, '\\d') and regexp_matches(case when g.item like '%/%' then c.path else split_part(c.path, '/', -1) end, g.rx))
      and not (question like '%1997%' and split_part(c.path, '/', -1) like '%1997%') as role
    from c join facts using (iid) left join newest n on n.file = c.path where tool in ('file_stats', 'file_rowcount')),
  roles as (select distinct iid, unnest([path] || list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[:i], '/') || '/')) as entry from told where role),
  entries as (
    select distinct l.path as scope, 'ls' as tool, l.path || '/' || split_part(substr(f.path, length(l.path) + 2), '/', 1) || case when substr(f.path, length(l.path) + 2) like '%/%' then '/' else '' end as entry
      from (select distinct path from c where tool = 'ls') l join files f on starts_with(f.path, l.path || '/')
    union all select l.path, 'find', f.path from (select distinct path from c where tool = 'find') l join files f on regexp_matches(f.path, '^' || replace(replace(l.path, '.', '\\.'), '*', '.*') || '$')),
  shown as (select c.iid, c.pos, c.tool, c.path, question, coalesce(answer, '') as answer, entry from c join facts using (iid) join entries n on n.tool = c.tool and n.scope = c.path),
  used as (select s.*, exists (select 1 from refs r where r.iid = s.iid and r.pos <> s.pos and r.item = s.entry) or exists (select 1 from globs g where g.iid = s.iid and g.pos <> s.pos
      and s.entry not like '%/' and regexp_matches(case when g.item like '%/%' then s.entry else split_part(s.entry, '/', -1) end, g.rx)) as used from shown s),
  kept as (select *, case when question like '%1997%' then replace(regexp_replace(replace(entry, '1997', '@'), '\\d+', '#', 'g'), '@', '1997') else {_LOOSE.format("entry")} end as series
    from (select *, bool_or(used) over (partition by iid, pos) as any_used from used) where (used or (not any_used and length(answer) >= 4 and contains(entry, answer))) and (iid, entry) not in (select iid, entry from roles)),
  ends as (select k.iid, k.pos, k.entry, k.series, max(n.entry) as newest, min(n.entry) as oldest, count(*) as n from kept k join entries n on n.tool = k.tool and n.scope = k.path and regexp_matches(n.entry, '^' || replace(replace(k.series, '.', '\\.'), '#', '\\d+') || '$') group by 1, 2, 3, 4),
  sizes as (select tool, scope, {_LOOSE.format("entry")} as series, count(*) as n from entries group by 1, 2, 3)
select iid, pos, case when role then 'newest' else 'file' end as kind, tool || ' ' || case when role then series else path end as item from told
union all select iid, pos, 'call', tool || ' ' || text from c where tool = 'sql'
union all select iid, pos, 'present', entry from kept
union all select distinct iid, pos, 'latest', series from ends where n >= 2 and newest = entry
union all select distinct iid, pos, 'earliest', series from ends where n >= 2 and oldest = entry
union all select distinct s.iid, s.pos, 'count', z.series from shown s join sizes z on z.tool = s.tool and z.scope = s.path and z.series = {_LOOSE.format("s.entry")} where s.answer = z.n::varchar"""


def _calls(spark, sf):
    e = table(spark, sf, "events")
    y = (1995 + F.col("event_id") % 7).cast("string")
    ds = F.substring(F.lit("FOP"), (1 + F.col("event_id") % 3).cast("int"), F.lit(1))
    mm = F.lpad((1 + F.floor(F.col("event_id") / 7) % 12).cast("string"), 2, "0")
    folder = F.concat(F.lit("lake/"), y)
    file = F.concat(folder, F.lit("/orders_"), ds, F.lit("_"), y, F.lit("-"), mm, F.lit(".parquet"))
    kind, n = F.col("event_type"), F.col("event_id")
    by = lambda *x: F.when(kind == "view", x[0]).when(kind == "click", x[1]).when(kind == "purchase", x[2]).when(kind == "signup", x[3]).otherwise(x[4])
    tool = by(*[F.lit(x) for x in ("ls", "find", "file_stats", "sql", "file_rowcount")])
    path = by(F.when(n % 5 == 0, F.lit("lake")).otherwise(folder), F.concat(folder, F.lit("/orders_"), ds, F.lit("_*.parquet")), file, F.lit(None), F.concat(F.lit("lake/2001/orders_"), ds, F.lit("_2001-08.parquet")))
    source = F.when(n % 2 == 0, file).otherwise(F.concat(F.lit("orders_"), ds, F.lit("_"), y, F.lit("-0?.parquet")))
    text = F.when(kind == "signup", F.concat(F.lit("select count(*) from '"), source, F.lit("'")))
    iid = F.concat_ws("-", "user_id", F.floor(F.dayofmonth("ts") / 8).cast("string"))
    user = F.col("user_id")
    question = F.when(user % 3 == 0, "How many orders of 1997?").otherwise("Which month is the newest?")
    answer = F.when(user % 4 == 0, "12").when(user % 4 == 1, "1998-03").when(user % 4 == 2, "3")
    return e.select(iid.alias("iid"), n.alias("pos"), tool.alias("tool"), path.alias("path"), text.alias("text")), e.select(iid.alias("iid"), question.alias("question"), answer.alias("answer")).distinct()


@query(_ANCHORS)
def anchored_traces(spark, sf):
    """Whole traces as queries that survive drift."""
    calls, facts = _calls(spark, sf)
    return traces.anchor_traces(calls, files(spark, sf), facts)


_SCHEMA = "case when ds = 'P' then 'a, b, c' else 'a, b' end"
_OBSERVED = f"""with {LAKE}, p as (select distinct ds, month, 'lake/' || ds || '/' || month || '.parquet' as path from o),
  tools as (select unnest(['file_rowcount', 'file_stats', 'file_schema']) as tool),
  q as (select 'file' as kind, 'file_stats' as tool, path as target from p union all select 'file', tool, 'old/' || month || '.parquet' from (select distinct month from p), tools
    union all select 'file', tool, 'gone/x.parquet' from tools union all select distinct 'newest', tool, 'lake/' || ds || '/#-#.parquet' from p, tools
    union all select 'present', null, path from p union all select distinct k, null, 'lake/' || ds || '/#-#.parquet' from p, (select unnest(['latest', 'earliest', 'count']) as k)),
  qs as (select kind || ' ' || coalesce(tool, '') || ' ' || target as query, * from q),
  stats as (select idx, v, ds, month, count(*) as n, min(round(o_totalprice, 2)::decimal(18,2)) as lo, max(round(o_totalprice, 2)::decimal(18,2)) as hi, count_if(o_totalprice is null) as nulls from held group by 1, 2, 3, 4),
  ws as (select w.idx, w.ds, w.month, 'lake/' || w.ds || '/' || w.month || '.parquet' as path, md5('lake/' || w.ds || '/' || w.month || '.parquet' || w.v) as sha, coalesce(n, 0) as n, lo, hi, coalesce(nulls, 0) as nulls, {_SCHEMA.replace('ds', 'w.ds')} as s
    from w left join stats using (idx, v, ds, month)),
  ends as (select idx, ds, max(path) as newest, min(path) as oldest, count(*) as n from ws group by 1, 2),
  deps as (
    select query, tool, ws.* from qs join ws on kind = 'file' and (target = path or (target like 'old/%' and target = 'old/' || month || '.parquet'))
    union all select query, tool, ws.* from qs join ends on kind = 'newest' and target = 'lake/' || ds || '/#-#.parquet' join ws on ws.idx = ends.idx and ws.path = newest),
  told as (select query, any_value(tool) as tool, idx, substr(sha1(string_agg(path || '=' || sha, chr(30) order by path)), 1, 16) as dep, sum(n)::bigint as n, min(lo) as lo, max(hi) as hi, sum(nulls)::bigint as nulls, min(s) as s0, max(s) as s1 from deps group by query, idx),
  said as (select query, idx, dep, case tool when 'file_rowcount' then n::varchar when 'file_stats' then 'rows=' || n || ' min=' || lo || ' max=' || hi || ' null_count=' || nulls
      else case when s0 = s1 then s0 else 'error: part files of this partition have different schemas' end end as observation from told
    union all select query, idx, null, 'present' from qs join ws on kind = 'present' and target = path
    union all select query, idx, null, case kind when 'latest' then newest when 'earliest' then oldest else n::varchar end from qs join ends on kind in ('latest', 'earliest', 'count') and target = 'lake/' || ds || '/#-#.parquet'),
  every as (select query, ms.idx, coalesce(observation, case when kind = 'present' then 'absent' when kind in ('latest', 'earliest') then '(none)' when kind = 'count' then '0' else 'error: no such file' end) as observation, dep
    from qs cross join ms left join said on said.query = qs.query and said.idx = ms.idx)
select query, idx, coalesce(dep, substr(sha1(observation), 1, 16)) as dep, observation, row_number() over (partition by query, coalesce(dep, substr(sha1(observation), 1, 16)) order by idx) = 1 as evaluate from every"""
_OBSERVED = _OBSERVED.replace("select query, ms.idx, coalesce(observation", "select qs.query, ms.idx, coalesce(observation")


@query(_OBSERVED)
def observations_at_snapshots(spark, sf):
    """What every kind of anchored query observes at every snapshot, each set of contents evaluated once: files by
    path, moved files by their partition (whose parts are merged), gone files, series and entries."""
    rows, lake, snapshots, _ = _lake(spark, sf)
    lake = lake.withColumn("part", F.col("month"))
    price = scalar.exact_cents(F.col("o_totalprice"))
    versions = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n_rows"), F.min(price).alias("lo"), F.max(price).alias("hi"), F.count_if(F.col("o_totalprice").isNull()).alias("nulls"), F.when(F.max("ds") == "P", "a, b, c").otherwise("a, b").alias("schema"))
    # a version without rows is a version, too
    empty = F.when(F.col("ds") == "P", "a, b, c").otherwise("a, b")
    versions = lake.select("sha", "ds").distinct().join(versions, "sha", "left").select("sha", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "nulls")], "lo", "hi", F.coalesce("schema", empty).alias("schema"))
    p = lake.select("ds", "month", "path").distinct()
    tools = F.explode(F.array(*[F.lit(t) for t in ("file_rowcount", "file_stats", "file_schema")])).alias("tool")
    none = F.lit(None).cast("string").alias("tool")
    series = F.concat(F.lit("lake/"), "ds", F.lit("/#-#.parquet")).alias("target")
    queries = p.select(F.lit("file").alias("kind"), F.lit("file_stats").alias("tool"), F.col("path").alias("target"))
    queries = queries.unionByName(p.select("month").distinct().select(F.lit("file").alias("kind"), tools, F.concat(F.lit("old/"), "month", F.lit(".parquet")).alias("target")))
    queries = queries.unionByName(p.select(F.lit("file").alias("kind"), F.lit("gone/x.parquet").alias("target")).distinct().select("kind", tools, "target"))
    queries = queries.unionByName(p.select("ds").distinct().select(F.lit("newest").alias("kind"), tools, series))
    queries = queries.unionByName(p.select(F.lit("present").alias("kind"), none, F.col("path").alias("target")))
    queries = queries.unionByName(p.select("ds").distinct().select(F.explode(F.array(*[F.lit(k) for k in ("latest", "earliest", "count")])).alias("kind"), none, series))
    queries = queries.withColumn("query", F.concat("kind", F.lit(" "), F.coalesce("tool", F.lit("")), F.lit(" "), "target"))
    return traces.observe_at_snapshots(queries, lake, versions, snapshots)


_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_NEAR = "list_min(list_transform({0}, lambda i: {{'d': abs(i - ({1})), 'i': i}})).i"
_CARRIED = f"""with recursive d as (select doc_id::varchar as path, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as l from documents where text is not null),
  v as (select path, t.version, case when t.version <> 4 then list_concat(list_transform(range(t.version), lambda i: 'header ' || i), list_filter(l, lambda x, i: t.version = 0 or i % (5 + t.version) <> t.version)) end as l from d, range(6) t(version)),
  asked(span, s, e) as (values (0, 2, 6), (1, 1, 200)),
  carried as (
    select path, span, s, e, -1::bigint as version, null::boolean as found, null::bigint as a, null::bigint as b, null::varchar as first, null::varchar as last, null::bigint as pos, null::bigint as len, null::varchar as observed from d, asked
    union all
    select path, span, s, e, version, l is not null and found, case when l is not null then a end, case when l is not null then b end,
      case when l is null or len(told) = 0 then first else l[i1] end, case when l is null or len(told) = 0 then last when least(b, n) < n then l[i2] end,
      case when l is null or len(told) = 0 then pos else i1 end, case when l is null or len(told) = 0 then len when least(b, n) >= n then n - i1 else i2 - i1 end,
      case when l is not null then coalesce(array_to_string(l[a:b], chr(10)), '') end
    from (select *, coalesce(list_filter(marked[len(told) // 2 + 1:], lambda i: i > 0 and i >= i1)[-1], told[-1]) as i2 from (
      select *, coalesce(list_filter(marked[1:greatest(1, len(told) // 2)], lambda i: i > 0)[1], told[1]) as i1 from (
        select *, list_transform(told, lambda i: case when length({_STRIP.format("l[i]")}) >= 6 and len(list_filter(l, lambda x: x = l[i])) = 1 then i else 0 end) as marked from (
          select *, list_filter(range(greatest(a, 1), least(b, n) + 1), lambda i: {_STRIP.format("l[i]")} <> '') as told from (
            select * replace (coalesce(a0, s) as a, case when a0 is null then least(e, n) else least(case when last is null then a0 + greatest(len + 50, 200) else coalesce({_NEAR.format("list_filter(range(a0, n + 1), lambda i: l[i] = last)", "a0 + len")}, a0 + len) end, n, a0 + 400) end as b, a0 is not null as found) from (
              select *, {_NEAR.format("list_filter(range(1, n + 1), lambda i: l[i] = first)", "pos")} as a0 from (
                select c.* replace (v.version as version), v.l, len(v.l) as n from carried c join v on v.path = c.path and v.version = c.version + 1))))))))
select path, span::bigint as span, version, found, a as start_line, b as end_line, case when found is not null and a is not null then first end as first, case when a is not null then last end as last, observed from carried where version >= 0"""


@query(_CARRIED)
def carried_spans(spark, sf):
    """Two spans of every document over six versions of it, in which lines come and go; in the fifth it isn't there."""
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n").alias("l"))
    rows = d.select("path", "l", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("version"))
    v = F.col("version")
    left = F.filter("l", lambda x, i: (v == 0) | ((i + 1) % (5 + v) != v))
    head = F.when(v > 0, F.transform(F.sequence(F.lit(1), F.greatest(v, F.lit(1))), lambda i: F.concat(F.lit("header "), i - 1))).otherwise(F.array().cast("array<string>"))
    versions = rows.select("path", "version", F.when(v != 4, F.array_join(F.concat(head, left), "\n")).alias("text"))
    asked = d.select("path", F.explode(F.array(*[F.struct(F.lit(i).alias("span"), F.lit(a).alias("start"), F.lit(b).alias("end")) for i, a, b in ((0, 2, 6), (1, 1, 200))])).alias("s")).select("path", "s.*")
    return spans.carry(asked, versions)
