"""Queries of dependency closures and of drawn facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import closure, profile
from palimpsest.plans.base import query, table

#: Customers are units: each depends on the one whose key is a third of its own, and some, for a while, on another.
_EDGES = """edges as (
    select c_custkey as unit, c_custkey // 3 as dep, c_custkey % 20 as a, case when c_custkey % 5 = 0 then c_custkey % 20 + 40 end as b from customer where c_custkey > 0
    union all select c_custkey, c_custkey // 5, 10, 30 from customer where c_custkey > 0 and c_custkey % 4 = 0),
  contents as (select c_custkey as unit, 'a' as sha, 0 as a, case when c_custkey % 7 = 0 then c_custkey % 60 + 5 end as b from customer union all select c_custkey, 'b', c_custkey % 60 + 5, null from customer where c_custkey % 7 = 0)"""


@query(
    f"""with recursive {_EDGES}, r(idx, unit, dep) as (
      select idx, c_custkey, c_custkey from customer, range(80) s(idx)
      union select r.idx, r.unit, e.dep from r join edges e on e.unit = r.dep and e.a <= r.idx and (e.b is null or e.b > r.idx)),
    s as (select r.unit, idx, sum(('0x' || substr(md5(dep || '=' || sha), 1, 15))::bigint::hugeint) as state, count(*) as n from r join contents c on c.unit = r.dep and c.a <= idx and (c.b is null or c.b > idx) group by 1, 2),
    p as (select * from (select *, lag(state) over w as s0, lag(n) over w as n0 from s window w as (partition by unit order by idx)) where s0 is null or s0 <> state or n0 <> n)
    select unit, idx as valid_from, state::varchar as state, n, row_number() over (partition by unit, state, n order by idx) = 1 as evaluate from p"""
)
def closure_states(spark, sf):
    """Each unit's state over the contents of all that it reaches, whenever it changes."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    k, none = F.col("k"), F.lit(None).cast("long")
    long = lambda x: x.cast("long")
    edges = c.where("k > 0").select(k.alias("unit"), long(F.floor(k / 3)).alias("dep"), long(k % 20).alias("valid_from"), F.when(k % 5 == 0, long(k % 20 + 40)).alias("valid_to"))
    edges = edges.unionByName(c.where("k > 0 and k % 4 = 0").select(k.alias("unit"), long(F.floor(k / 5)).alias("dep"), F.lit(10).cast("long").alias("valid_from"), F.lit(30).cast("long").alias("valid_to")))
    turn = long(k % 60 + 5)
    contents = c.select(k.alias("unit"), F.lit("a").alias("sha"), F.lit(0).cast("long").alias("valid_from"), F.when(k % 7 == 0, turn).alias("valid_to"))
    contents = contents.unionByName(c.where("k % 7 = 0").select(k.alias("unit"), F.lit("b").alias("sha"), turn.alias("valid_from"), none.alias("valid_to")))
    return closure.states(contents, edges).select("unit", "valid_from", F.col("state").cast("string").alias("state"), "n", "evaluate")


def _h(use: str, t: str = "") -> str:
    return f"('0x' || substr(md5('quota|{use}|' || {t}type || '|' || {t}fact), 1, 15))::bigint"


_QUOTA = f"""with c as (select o_orderpriority as type, o_orderkey as fact, o_orderstatus <> 'P' as valid, o_custkey % case o_orderpriority when '1-URGENT' then 3 when '2-HIGH' then 25 when '5-LOW' then 1000 else 90 end = 1 as changing from orders),
  s as (select *, row_number() over (partition by type order by {_h('scan')}, fact) as pos from c),
  pool as (select * from (select *, row_number() over (partition by type order by pos) as i from s where valid) where i <= 150),
  nat as (select type, fact from (select *, row_number() over (partition by type order by {_h('natural')}, fact) as r from pool) where r <= 11),
  rest as (select * from pool where (type, fact) not in (select type, fact from nat)),
  ends as (select type, max(pos) as upto from pool group by type having count(*) = 150),
  have as (select type, count(*) as have from rest where changing group by type),
  beyond as (select s.type, s.fact, row_number() over (partition by s.type order by pos) as j, 33 - coalesce(have, 0) as want from s join ends using (type) left join have using (type) where pos > upto and pos <= upto + 600 and valid and changing),
  cand as (select type, fact from rest where changing union all select type, fact from beyond where j <= want),
  rich as (select type, fact from (select *, row_number() over (partition by type order by {_h('enriched')}, fact) as r from cand) where r <= 11),
  fill as (select f.type, f.fact from (select *, row_number() over (partition by type order by {_h('fill')}, fact) as r from rest where (type, fact) not in (select type, fact from rich)) f
    left join (select type, count(*) as n from rich group by type) x using (type) where r <= 11 - coalesce(n, 0))
select *, 'natural' as kind from nat union all select *, 'enriched' from rich union all select *, 'fill' from fill"""


@query(_QUOTA)
def quota_sampled_facts(spark, sf):
    """Facts of each type by quota, enriched with ones that change, filled from the pool where these are too few."""
    o = table(spark, sf, "orders")
    rare = F.when(F.col("o_orderpriority") == "1-URGENT", 3).when(F.col("o_orderpriority") == "2-HIGH", 25).when(F.col("o_orderpriority") == "5-LOW", 1000).otherwise(90)
    rows = o.select(F.col("o_orderpriority").alias("type"), F.col("o_orderkey").alias("fact"), (F.col("o_orderstatus") != "P").alias("valid"), (F.col("o_custkey") % rare == 1).alias("changing"))
    return profile.quota_sample(rows, "quota")
