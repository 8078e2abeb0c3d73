"""Queries of facts at every snapshot, through step functions over the change log.

The lake: each status and month of orders is a part that arrives with its month; a December part
first lacks its late rows (order keys divisible by 32) and is replaced by the whole one a snapshot
later; a June part is removed 24 snapshots after its arrival.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import inference, manifest, steps
from palimpsest.plans.base import query, table
from palimpsest.sources import working

#: Every version with its bounds, and w: the versions at each snapshot.
LAKE = """o as (select *, strftime(o_orderdate, '%Y-%m') as month, o_orderstatus as ds from orders),
  ms as (select month, row_number() over (order by month) - 1 as idx from (select distinct month from o)),
  events as (
    select ds, month, idx, 'a' as v from (select distinct ds, month from o) join ms using (month)
    union all select ds, month, idx + 1, 'c' from (select distinct ds, month from o) join ms using (month) where month like '%-12'
    union all select ds, month, idx + 24, null from (select distinct ds, month from o) join ms using (month) where month like '%-06'),
  versions as (select * from (select ds, month, v, idx as valid_from, lead(idx) over (partition by ds, month order by idx) as valid_to from events) where v is not null),
  w as (select s.idx, ds, v.month, v from versions v join ms s on s.idx >= valid_from and (valid_to is null or s.idx < valid_to)),
  held as (select w.idx, w.v, o.* from w join o using (ds, month) where not (w.v = 'a' and month like '%-12' and o_orderkey % 32 = 0)),
  facts as (select distinct ds || ':' || p as fact, ds, p as period from (select ds, unnest([month, substr(month, 1, 4), 'all']) as p from o) where length(p) < 7),
  series as (select fact, h.* from facts f join held h on f.ds = h.ds and (period = 'all' or h.month like period || '%'))"""


def _path(ds, month):
    return F.concat(F.lit("lake/"), ds, F.lit("/"), month, F.lit(".parquet"))


def _lake(spark, sf):
    """Rows with the version (sha) they stand in, files (ds, month, path, sha, valid_from, valid_to), snapshots, facts."""
    o = table(spark, sf, "orders").withColumn("month", scalar.month_of(F.col("o_orderdate"))).withColumn("ds", F.col("o_orderstatus"))
    december, june = F.col("month").endswith("-12"), F.col("month").endswith("-06")
    parts = o.select("ds", "month").distinct()
    snapshots = working.kept(inference.numbered(o.select("month").distinct(), "month", "idx"))
    path = _path(F.col("ds"), F.col("month"))
    later = F.when(december, F.array(F.struct(F.lit(0).alias("by"), F.lit("a").alias("v")), F.struct(F.lit(1).alias("by"), F.lit("c").alias("v")))).when(june, F.array(F.struct(F.lit(0).alias("by"), F.lit("a").alias("v")), F.struct(F.lit(24).alias("by"), F.lit(None).cast("string").alias("v"))))
    events = parts.join(snapshots, "month").select("ds", "month", path.alias("path"), "idx", F.explode(F.coalesce(later, F.array(F.struct(F.lit(0).alias("by"), F.lit("a").alias("v"))))).alias("e"))
    log = events.select("path", (F.col("idx") + F.col("e.by")).alias("idx"), F.when(F.col("e.v").isNotNull(), F.md5(F.concat("path", "e.v"))).alias("sha"))
    files = manifest.fold(log).withColumn("ds", F.split_part("path", F.lit("/"), F.lit(2))).withColumn("month", F.substring(F.split_part("path", F.lit("/"), F.lit(3)), 1, 7))
    files = working.kept(files)  # the log is small beside the data, and every step starts from it
    late = december & (F.col("o_orderkey") % 32 == 0)
    v = F.explode(F.when(late, F.array(F.lit("c"))).when(december, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("a"))))
    rows = o.withColumn("v", v).withColumn("sha", F.md5(F.concat(path, "v")))
    facts = files.select("ds", "month").distinct().select("ds", F.explode(F.array(F.substring("month", 1, 4), F.lit("all"))).alias("period")).distinct().select(F.concat_ws(":", "ds", "period").alias("fact"), "ds", "period")
    return rows, files, snapshots.select("idx"), facts


_FAILED = 300_000


@query(
    f"""with {LAKE}, members as (select distinct substr(o_orderpriority, 1, 1) as model, idx, month, o_custkey as k, o_totalprice > {_FAILED} as failed from held),
    cohort as (select distinct month as cohort, model, idx, k from members where month like '%-01'),
    failing as (select distinct c.cohort, c.model, c.idx, c.k from cohort c join members m on m.idx = c.idx and m.k = c.k and m.month >= c.cohort and m.failed)
    select cohort, model, idx, count(*) as n_cohort, count(f.k) as n_failed from cohort left join failing f using (cohort, model, idx, k) group by 1, 2, 3"""
)
def cohort_at_snapshots(spark, sf):
    """Customers first seen in a January under a model, and how many of them have failed since, at every snapshot:
    each version's key set is made once, and merged across versions by the stretches that hold a key."""
    rows, files, snapshots, _ = _lake(spark, sf)
    sets = steps.key_sets(rows.select("sha", F.substring("o_orderpriority", 1, 1).alias("model"), F.col("o_custkey").alias("k"), (F.col("o_totalprice") > _FAILED).alias("failed")), "sha", "model", "k", "failed")
    held = sets.join(files.select("sha", "month", "valid_from", "valid_to"), "sha")
    by = ["cohort", "model"]
    cohort = held.where(F.col("month").endswith("-01")).select(F.col("month").alias("cohort"), "model", "k", "valid_from", "valid_to", F.lit("cohort").alias("role")).distinct()
    ever = cohort.select(*by, "k").distinct()
    # a customer's failures only meet the cohorts that the customer is in
    failed = held.where("failed").select("k", "month", "valid_from", "valid_to").distinct()
    failing = ever.join(failed, "k").where(F.col("month") >= F.col("cohort")).select(*by, "k", "valid_from", "valid_to", F.lit("failed").alias("role"))
    whole = steps.at(steps.covered(cohort, by, "k", ["cohort"], "n_cohort"), snapshots).where("n_cohort > 0")
    both = steps.at(steps.covered(cohort.unionByName(failing), by, "k", ["cohort", "failed"], "n_failed"), snapshots)
    return whole.join(both, [*by, "idx"], "left").select(*by, "idx", "n_cohort", F.coalesce("n_failed", F.lit(0)).alias("n_failed"))


@query(f"with {LAKE} select fact, idx, count(distinct o_custkey) as n_customers, count(distinct o_orderpriority) as n_models from series group by 1, 2")
def distinct_at_snapshots(spark, sf):
    rows, files, snapshots, facts = _lake(spark, sf)
    deps = steps.dependencies(facts, files)

    def counted(column, name):
        members = steps.key_sets(rows, "sha", column).join(deps, "sha").select("fact", column, "valid_from", "valid_to", F.lit("any").alias("role"))
        return steps.at(steps.covered(members, ["fact"], column, ["any"], name), snapshots)

    both = counted("o_custkey", "n_customers").join(counted("o_orderpriority", "n_models"), ["fact", "idx"])
    return both.where("n_customers > 0")


@query(
    f"""with {LAKE}, c as (select fact, idx, o_custkey as k, count(*) as n from series group by 1, 2, 3),
    r as (select *, row_number() over (partition by fact, idx order by n desc, k) as r from c)
    select fact, idx, string_agg(k, ', ' order by r) as answer from r where r <= 3 group by 1, 2"""
)
def topk_at_snapshots(spark, sf):
    """The three customers with most orders of each fact, at every snapshot."""
    rows, files, snapshots, facts = _lake(spark, sf)
    keyed = rows.groupBy("sha", "o_custkey").agg(F.count(F.lit(1)).alias("n"))
    counts = steps.totals(keyed.join(steps.dependencies(facts, files), "sha"), ["fact", "o_custkey"], ["n"])
    return steps.joined_text(steps.top_at(counts, ["fact"], "o_custkey", "n", 3, snapshots), ["fact"], "o_custkey")


@query(
    f"""with {LAKE}, q as (select fact, idx, count(*) as b, count_if(o_totalprice > {_FAILED}) as a, sum(round(o_totalprice, 2)::decimal(18,2)) as total from series group by 1, 2),
    e as (select *, a * 100000 // b as f, 2 * (a * 100000 % b) as r from q)
    select fact, idx, ((f + case when r > b or (r = b and f % 2 = 1) then 1 else 0 end) / 100000)::decimal(20,5)::varchar as high_frac, total, b as n from e"""
)
def quality_at_snapshots(spark, sf):
    """A share of rows (five places, ties to even), an exact sum and a count of each fact, at every snapshot."""
    rows, files, snapshots, facts = _lake(spark, sf)
    x = F.col("o_totalprice")
    per = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.count_if(x > _FAILED).alias("bad"), F.sum(scalar.exact_cents(x)).alias("total"))
    steps_ = steps.totals(steps.dependencies(facts, files).join(per, "sha"), ["fact"], ["n", "bad", "total"])
    out = steps.at(steps_.where("n_files > 0"), snapshots)
    return out.select("fact", "idx", scalar.answer(scalar.ratio_half_even(F.col("bad"), F.col("n"), 5)).alias("high_frac"), F.col("total").cast("decimal(38,2)").alias("total"), "n")


@query(
    f"""with {LAKE}, z as (select fact, s.idx, c_nationkey as k, count(*) as n from series s left join customer on c_custkey = o_custkey group by 1, 2, 3),
    named as (select fact, idx, case when n_name is null or (idx < 40 and n_nationkey % 5 = 0) then 'UNMATCHED_ID' else n_name end as name, n from z left join nation on n_nationkey = k),
    b as (select fact, idx, name, sum(n)::bigint as n from named group by 1, 2, 3),
    r as (select *, row_number() over (partition by fact, idx order by n desc, name) as r from b)
    select fact, idx, max(name) filter (where r = 1) as answer, coalesce(max(n) filter (where name = 'UNMATCHED_ID'), 0) as n_unmatched from r group by 1, 2"""
)
def lookups_at_snapshots(spark, sf):
    """The nation with most orders of each fact, and the orders without one, at every snapshot; the lookup has two
    versions, of which the first lacks every fifth nation."""
    rows, files, snapshots, facts = _lake(spark, sf)
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"))
    fifth = F.col("k") % 5 == 0
    lookup = nations.where(~fifth).withColumn("valid_from", F.lit(0).cast("long")).withColumn("valid_to", F.lit(40).cast("long"))
    lookup = lookup.unionByName(nations.withColumn("valid_from", F.lit(40).cast("long")).withColumn("valid_to", F.lit(None).cast("long")))
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("k"))
    # keys are counted per version before they meet facts or names
    keyed = rows.groupBy("sha", "o_custkey").agg(F.count(F.lit(1)).alias("n")).join(customer, "o_custkey", "left").groupBy("sha", "k").agg(F.sum("n").alias("n"))
    spans = keyed.join(steps.dependencies(facts, files), "sha")
    counts = steps.totals(steps.looked_up(spans, lookup, ["fact"], "k", "name"), ["fact", "name"], ["n"])
    top = steps.top_at(counts, ["fact"], "name", "n", 1, snapshots).select("fact", "idx", F.col("name").alias("answer"))
    loose = steps.at(counts.where("name = 'UNMATCHED_ID' and n > 0").select("fact", "valid_from", "valid_to", F.col("n").alias("n_unmatched")), snapshots)
    return top.join(loose, ["fact", "idx"], "left").withColumn("n_unmatched", F.coalesce("n_unmatched", F.lit(0)))


@query(
    f"""with {LAKE}, p as (select idx, ds, month, count(*) % 3 <> 0 as has from held group by 1, 2, 3)
    select ds, idx, coalesce(min(month) filter (where has), 'NONE') as first_month, coalesce(max(month) filter (where has), 'NONE') as latest_month, count_if(has) as n_months, max(month) as newest from p group by 1, 2"""
)
def coverage_at_snapshots(spark, sf):
    """First, last and number of months of each status whose part has a column (here: rows that don't divide by
    three), and its newest month, at every snapshot."""
    rows, files, snapshots, _ = _lake(spark, sf)
    per = rows.groupBy("sha").agg((F.count(F.lit(1)) % 3 != 0).alias("has"))
    spans = files.join(per, "sha").select("ds", "month", "has", F.lit(1).cast("long").alias("n"), "valid_from", "valid_to")
    number = F.translate("month", "-", "").cast("long")  # months as numbers, so that the last one is a greatest count
    having, any_ = spans.where("has"), steps.totals(spans, ["ds", "month"], ["n"])
    there = steps.totals(having, ["ds", "month"], ["n"])
    one = lambda s, name: steps.top_at(s, ["ds"], "month", "n", 1, snapshots).select("ds", "idx", F.col("month").alias(name))
    by_number = lambda s: s.withColumn("n", F.when(F.col("n") > 0, number).otherwise(0))
    months = steps.at(steps.covered(having.withColumn("role", F.lit("any")), ["ds"], "month", ["any"], "n_months"), snapshots)
    out = one(by_number(any_), "newest")
    for t in (one(there, "first_month"), one(by_number(there), "latest_month"), months):
        out = out.join(t, ["ds", "idx"], "left")
    return out.select("ds", "idx", *[scalar.answer(F.col(c)).alias(c) for c in ("first_month", "latest_month")], F.coalesce("n_months", F.lit(0)).alias("n_months"), "newest")


@query(
    f"""with {LAKE}, s as (select idx, sum(('0x' || substr(md5(p || '=' || md5(p || v)), 1, 15))::bigint::hugeint) as state, count(*) as n_files
      from (select idx, v, 'lake/' || ds || '/' || month || '.parquet' as p from w) group by 1)
    select idx, state::varchar as state, n_files, row_number() over (partition by state, n_files order by idx) = 1 as evaluate from s"""
)
def world_hash_at_snapshots(spark, sf):
    """The lake's state at every snapshot as an order-independent hash, running over the change log."""
    _, files, snapshots, _ = _lake(spark, sf)
    found = steps.world_states(files)
    first = steps.at(found.withColumn("start", F.col("valid_from")), snapshots)
    return first.select("idx", F.col("state").cast("string").alias("state"), "n_files", (F.col("evaluate") & (F.col("idx") == F.col("start"))).alias("evaluate"))
