"""Queries of evidence, policies, records, arrivals and inference."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import arrivals, evidence, inference, manifest, policies, records
from palimpsest.plans import base
from palimpsest.plans.base import INTERVALS, LOG, RECORDS, log, query, table
from palimpsest.streaming import facade

WORLDS = INTERVALS + ", worlds as (select i.path, i.sha, s.idx from intervals i join (select distinct idx from log) s on i.valid_from <= s.idx and (i.valid_to is null or i.valid_to > s.idx))"
DEPS = WORLDS + ", deps as (select idx, substr(sha1(string_agg(path || '=' || sha, chr(30) order by path)), 1, 16) as dep from worlds group by idx)"


def _deps(spark, sf):
    changes = log(spark, sf).select("path", "idx", "sha")
    w = manifest.worlds(manifest.fold(changes), changes.select("idx").distinct())
    return evidence.dependency_key(w, ["idx"])


@query(f"with {DEPS} select idx, dep from deps")
def fingerprint_state(spark, sf):
    return _deps(spark, sf)


@query(f"with {DEPS} select idx, dep, row_number() over (partition by dep order by idx) = 1 as evaluate from deps")
def dep_hash_memo(spark, sf):
    return evidence.memo(_deps(spark, sf), [], "idx")


@query(f"with {DEPS} select idx, dep as state, coalesce(dep <> lag(dep) over (order by idx), false) as changed from deps")
def state_change_points(spark, sf):
    d = _deps(spark, sf).select(F.lit(1).alias("k"), "idx", F.col("dep").alias("state"))
    return evidence.change_points(d, ["k"], "idx").select("idx", "state", "changed")


def _reads(spark, sf):
    r = base.records(spark, sf)
    verdict = F.element_at(F.array(F.lit("still_valid"), F.lit("changed"), F.lit("unsure")), ((F.col("event_id") % 3) + 1).cast("int"))
    return r.select("iid", "t", F.col("answer").alias("truth"), "state", (F.col("eval_tok") + 10).alias("tokens"), verdict.alias("verdict"))


READS = RECORDS + ", reads as (select iid, t, answer as truth, state, eval_tok + 10 as tokens from records)"


def _served(derived: str) -> str:
    return f"""with {READS}, d as (select *, {derived} as derived from reads),
    s as (select *, last_value(case when derived then truth end ignore nulls) over (partition by iid order by t rows unbounded preceding) as served from d)
    select iid, t, derived, served, served <> truth as wrong from s"""


def _shown(rows):
    return rows.select("iid", "t", "derived", "served", "wrong")


@query(_served("t = 1"))
def policy_never(spark, sf):
    return _shown(policies.never(_reads(spark, sf)))


@query(_served("true"))
def policy_always(spark, sf):
    return _shown(policies.always(_reads(spark, sf)))


@query(_served("row_number() over (partition by iid, t // 7 order by t) = 1"))
def policy_ttl_epoch(spark, sf):
    return _shown(policies.ttl_epoch(_reads(spark, sf), 7))


@query(_served("(t - 1) % 7 = 0"))
def policy_ttl_age(spark, sf):
    return _shown(policies.ttl_age(_reads(spark, sf), 7))


@query(_served("coalesce(state <> lag(state) over (partition by iid order by t), true)"))
def policy_oracle_replay(spark, sf):
    return _shown(policies.guard(_reads(spark, sf)))


@query(f"with {READS} select iid, t, case when state = first_value(state) over (partition by iid order by t) then 'same' when row_number() over (partition by iid, state order by t) > 1 then 'memo' else 'eval' end as action from reads")
def detect_memo_actions(spark, sf):
    return policies.detect(_reads(spark, sf)).select("iid", "t", "action")


@query(
    f"""with recursive {READS}, v as (select r.*, ['still_valid', 'changed', 'unsure'][e.event_id % 3 + 1] as verdict, row_number() over (partition by iid order by t) as i from reads r join (select iid, t, event_id from records) e using (iid, t)),
    m as (
      select iid, i, t, 'derive' as action, truth as served, false as wrong, 0::bigint as eval_tok, tokens as der_tok, state as anchor, t as since, []::varchar[] as memo from v where i = 1
      union all
      select iid, i, t, action, case when anew then truth else served end, (case when anew then truth else served end) <> truth, case when action in ('valid', 'repair', 'rederive') then tokens // 10 else 0 end, case when anew then tokens else 0 end,
        case when anew then state else anchor end, case when anew then t else since end, case when anew then [] when action = 'valid' then list_append(memo, state) else memo end
      from (select *, action in ('forced', 'repair', 'rederive') as anew from (
        select v.iid, v.i, v.t, v.truth, v.state, v.tokens, m.served, m.anchor, m.since, m.memo,
          case when v.t - m.since >= 40 then 'forced' when v.state = m.anchor then 'same' when list_contains(m.memo, v.state) then 'memo' when verdict = 'still_valid' then 'valid' when verdict = 'changed' then 'repair' else 'rederive' end as action
        from m join v on v.iid = m.iid and v.i = m.i + 1)))
    select iid, t, action, served, wrong, eval_tok, der_tok from m"""
)
def policy_verdict_driven(spark, sf):
    """A state machine whose evidence depends on its own actions."""
    return policies.verdict_driven(_reads(spark, sf), force_after=40)


@query(f"with {READS} select iid, t from reads where t % 5 = 0")
def schedule_every5(spark, sf):
    return policies.schedule(_reads(spark, sf), "every5").select("iid", "t")


_COUNTS = f"""{READS}, l as (select *, lag(state) over (partition by iid order by t) as s0, lag(truth) over (partition by iid order by t) as v0, row_number() over (partition by iid order by t) as i from reads)"""


@query(f"with {_COUNTS} select iid, count(distinct state) as n_states, count_if(i > 1 and state <> s0) as n_changes, count_if(i > 1 and truth <> v0 and state = s0) as n_incomplete from l group by iid")
def evidence_state_counts(spark, sf):
    return evidence.state_counts(_reads(spark, sf), ["iid"], "t", "truth")


_FACTS = RECORDS + """, facts as (select iid, count(*) as n_reads, count_if(flagged and stored_valid) as n_false_flag, count_if(not flagged and not stored_valid) as n_false_silent,
  count_if(stored_valid) as n_valid, count_if(not stored_valid) as n_invalid, count_if(not served_valid) as n_wrong, count_if(action = 'rederive') as n_rederive, count_if(action = 'repair') as n_repair,
  count_if(action = 'rederive' and stored_valid) as n_needless, sum(eval_tok)::bigint as eval_tok, sum(der_tok)::bigint as der_tok, sum(eval_tok + der_tok)::bigint as tok, bool_or(not served_valid) as ever_wrong from records group by iid)"""


@query(f"with {_FACTS} select * from facts")
def per_fact_metrics(spark, sf):
    return records.per_fact(base.records(spark, sf))


@query(
    f"""with {_FACTS} select sum(n_false_flag) / greatest(sum(n_valid), 1) as false_flag_rate, sum(n_false_silent) / greatest(sum(n_invalid), 1) as false_silent_rate, sum(n_wrong) / greatest(sum(n_reads), 1) as served_wrong,
    sum(tok) / greatest(count(*), 1) as tok_per_fact, sum(tok) / greatest(sum(n_reads), 1) as tok_per_read, sum(n_rederive) / greatest(count(*), 1) as rederivations_per_fact, sum(n_needless) / greatest(sum(n_rederive), 1) as needless_share, count_if(ever_wrong) / greatest(count(*), 1) as ever_wrong_share from facts"""
)
def summary_ratios(spark, sf):
    return records.summary(records.per_fact(base.records(spark, sf)))


@query(f"with {_FACTS}, g as (select iid % 5 as g, sum(n_wrong) / greatest(sum(n_reads), 1) as rate from facts group by 1) select avg(rate) as mean_rate, count(*) as n_groups from g")
def equal_weight_mean(spark, sf):
    return records.group_mean(records.per_fact(base.records(spark, sf)).withColumn("g", F.col("iid") % 5), "g", "n_wrong", "n_reads")


_ISLANDS = RECORDS + """, b as (select *, lag(served_valid) over (partition by iid order by t) as before, lead(t) over (partition by iid order by t) as next_t from records),
  i as (select *, sum(case when not served_valid and coalesce(before, true) then 1 else 0 end) over (partition by iid order by t) as episode from b),
  e as (select *, row_number() over (partition by iid, episode order by t) - 1 as pos from i where not served_valid),
  eps as (select iid, episode::bigint as episode, min(t) as start_t, max(t) as end_t, count(*) as n_reads, min(pos) filter (where flagged) as delay, max_by(next_t is null, t) as censored from e group by 1, 2)"""


@query(f"with {_ISLANDS} select * from eps")
def episodes_islands(spark, sf):
    return records.episodes(base.records(spark, sf))


@query(f"with {_ISLANDS} select case when n_reads <= 1 then '1' when n_reads <= 2 then '2' when n_reads <= 4 then '3-4' else '5+' end as bin, count(*) as n, count_if(delay is null) as n_missed from eps group by 1")
def episode_histogram(spark, sf):
    return records.episode_bins(records.episodes(base.records(spark, sf)))


@query(f"with {_ISLANDS} select avg(delay) as mean_delay, count(delay) as n_detected, count(*) as n_episodes from eps")
def detection_delay(spark, sf):
    return records.episodes(base.records(spark, sf)).agg(F.avg("delay").alias("mean_delay"), F.count("delay").alias("n_detected"), F.count(F.lit(1)).alias("n_episodes"))


@query(
    f"""with {RECORDS}, m as (select *, min(t) filter (where not stored_valid) over (partition by iid) as fi, min(t) filter (where action not in ('same', 'memo', 'valid', 'none')) over (partition by iid) as fa from records)
    select iid, count_if(fi is null or t < fi) as life, count_if((fi is null or t < fi) and (fa is null or t < fa)) as kept from m group by iid"""
)
def lifetime_kept(spark, sf):
    return records.lifetime_kept(base.records(spark, sf))


@query(
    f"""with {RECORDS}, a as (select *, last_value(case when action not in ('same', 'memo') then t end ignore nulls) over w as lt, last_value(case when action not in ('same', 'memo') then action end ignore nulls) over w as la,
      last_value(case when action not in ('same', 'memo') then served_valid end ignore nulls) over w as lv from records window w as (partition by iid order by t rows unbounded preceding))
    select iid, t, case when lt is null then 'original_expired' when lt = t then 'wrong_' || la when not lv then 'kept_wrong_' || la else 'expired_' || la end as cause from a where not served_valid"""
)
def taxonomy_origin(spark, sf):
    return records.taxonomy(base.records(spark, sf))


@query(f"with {_ISLANDS} select count_if(f in ('rederive', 'repair')) as anchored, count(*) as wrong from (select first_value(action) over (partition by iid, episode order by t) as f from e)")
def anchored_share(spark, sf):
    return records.anchored_share(base.records(spark, sf))


@query(
    f"""with {RECORDS}, n as (select served_valid as v, answer as a, lead(served_valid) over w as nv, lead(answer) over w as na from records where der_tok > 0 window w as (partition by iid order by t))
    select count(*) as pairs, count_if(not v) as wrong_now, count_if(not v and not nv) as wrong_both, count_if(not v and not nv and a = na) as same_answer from n where nv is not null"""
)
def consecutive_pairs(spark, sf):
    return records.consecutive_pairs(base.records(spark, sf))


@query(
    f"""with {_ISLANDS}, u as (select *, min(case when served_valid then time end) over (partition by iid order by t rows between 1 following and unbounded following) as until from i)
    select iid, episode::bigint as episode, min(time) as since, max(until) as until, count(*) as n_reads from u where not served_valid group by 1, 2"""
)
def stale_windows(spark, sf):
    return records.stale_windows(base.records(spark, sf))


@query(
    f"""with {RECORDS}, v as (select iid, t, case when event_id % 4 = 0 then 'NONE' else answer end as value from records), b as (select *, lag(value) over w as before, lead(t) over w as nxt from v window w as (partition by iid order by t)),
    r as (select *, sum(case when value = 'NONE' and coalesce(before, '') <> 'NONE' then 1 else 0 end) over (partition by iid order by t) as run from b)
    select iid, min(t) as start_t, count(*) as n, max_by(nxt is not null, t) as temporary from r where value = 'NONE' group by iid, run"""
)
def none_runs(spark, sf):
    r = base.records(spark, sf)
    return records.none_runs(r.select("iid", "t", F.when(F.col("event_id") % 4 == 0, "NONE").otherwise(F.col("answer")).alias("value")))


@query(
    f"""with {_FACTS}, p as (select iid % 20 as policy, sum(tok)::bigint as cost, sum(n_wrong)::bigint as err from facts group by 1),
    m as (select *, min(err) over (order by cost, err rows between unbounded preceding and 1 preceding) as best from p) select policy, cost, err from m where best is null or err < best"""
)
def pareto_frontier(spark, sf):
    f = records.per_fact(base.records(spark, sf)).groupBy((F.col("iid") % 20).alias("policy")).agg(F.sum("tok").alias("cost"), F.sum("n_wrong").alias("err"))
    return records.pareto(f, "cost", "err")


@query(f"with {_FACTS}, p as (select iid % 20 as policy, sum(tok)::bigint as cost, sum(n_wrong) / sum(n_reads) as err from facts group by 1) select policy, cost, err from p where err <= (select min(err) from p) + 0.05 order by cost, err limit 1")
def frozen_choice(spark, sf):
    f = records.per_fact(base.records(spark, sf)).groupBy((F.col("iid") % 20).alias("policy")).agg(F.sum("tok").alias("cost"), (F.sum("n_wrong") / F.sum("n_reads")).alias("err"))
    return records.cheapest_near_best(f, "cost", "err", 0.05)


_CLOCK = "clock as (select user_id % 10 as repo, ts as time, event_id as t from events where event_type = 'signup'), tasks as (select user_id % 10 as repo, ts as time, event_id as task from events where event_type = 'click')"


@query(f"with {_CLOCK} select tasks.repo, tasks.time, tasks.task, clock.t from tasks asof left join clock on tasks.repo = clock.repo and tasks.time >= clock.time")
def asof_clock_join(spark, sf):
    e = table(spark, sf, "events").withColumn("repo", F.col("user_id") % 10)
    clock = e.where("event_type = 'signup'").select("repo", F.col("ts").alias("time"), F.col("event_id").alias("t"))
    return arrivals.asof(e.where("event_type = 'click'").select("repo", F.col("ts").alias("time"), F.col("event_id").alias("task")), clock, "repo").select("repo", "time", "task", "t")


@query(
    f"""with {RECORDS}, c as (select iid, t, sum(eval_tok + der_tok) over w as upto, max(case when eval_tok > 0 then t else 0 end) over w as le, max(case when der_tok > 0 then t else 0 end) over w as ld from records window w as (partition by iid order by t)),
    f as (select iid, t, coalesce(lag(t) over (partition by iid order by t), 0) as p from records where action = 'memo')
    select f.iid, f.t, f.p, (coalesce(case when c.le > f.p then e.eval_tok end, 0) + coalesce(case when c.ld > f.p then d.der_tok end, 0))::bigint as lazy_tok, (c.upto - coalesce(b.upto, 0))::bigint as sum_tok
    from f join c using (iid, t) left join c b on b.iid = f.iid and b.t = f.p left join records e on e.iid = f.iid and e.t = c.le left join records d on d.iid = f.iid and d.t = c.ld"""
)
def lazy_coalesced_cost(spark, sf):
    r = base.records(spark, sf)
    return arrivals.lazy_cost(r.where("action = 'memo'").select("iid", "t", "time"), r.select("iid", "t", "eval_tok", "der_tok"))


@query(f"with {RECORDS} select iid, sum(eval_tok + der_tok)::bigint as eager_tok, count_if(der_tok > 0) as n_derived from records group by iid")
def eager_cost(spark, sf):
    return arrivals.eager_cost(base.records(spark, sf))


@query(
    f"""with {RECORDS}, w as (select iid, t as u, answer as truth from records), d as (select iid, t, answer as dtruth, der_tok as tokens from records where der_tok > 0),
    j as (select w.iid, w.u, d.t, d.tokens, case when d.t is null then 'none' when d.t = w.u then 'exact' when dtruth = truth then 'same_truth' else 'other_truth' end as kind, row_number() over (partition by w.iid, w.u order by (dtruth is distinct from truth), abs(d.t - w.u), d.t) as r from w left join d on w.iid = d.iid)
    select iid, u, t, tokens, kind from j where r = 1"""
)
def impute_nearest(spark, sf):
    r = base.records(spark, sf)
    wanted = r.select("iid", F.col("t").alias("u"), F.col("answer").alias("truth"))
    return arrivals.impute_nearest(wanted, r.where("der_tok > 0").select("iid", "t", F.col("answer").alias("truth"), F.col("der_tok").alias("tokens")))


@query(f"with {RECORDS}, d as (select iid, t, answer, served_valid as v from records where der_tok > 0) select count(*) as pairs, count_if(not a.v and not b.v) as both_wrong, count_if(not a.v and not b.v and a.answer = b.answer) as same_wrong from d a join d b on a.iid = b.iid and a.t < b.t")
def pair_persistence(spark, sf):
    r = base.records(spark, sf).where("der_tok > 0")
    return inference.pair_persistence(r.select("iid", "answer", F.col("served_valid").alias("valid")))


@query("select g as repo, count(*) as n_tasks, count_if(not ok) as n_wrong from (select user_id % 5 as g, user_id, date_trunc('day', ts) as day, bool_and(event_type <> 'error') as ok from events group by 1, 2, 3) group by 1")
def task_wrong_rollup(spark, sf):
    r = base.records(spark, sf).withColumn("repo", F.col("iid") % 5).withColumn("task", F.struct("iid", F.date_trunc("day", "time")))
    return arrivals.task_rollup(r, "task", "repo")


@query("with e as (select user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts))) / 1000000 as gap from events) select user_id as iid, count(gap) as n, avg(gap) as mean_gap, stddev_pop(gap) / avg(gap) as cv from e where gap is not null group by 1")
def interarrival_stats(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("iid"), F.col("ts").alias("time"))
    return arrivals.interarrival(e, "iid")


@query("select user_id % 10 as repo, event_id, max(ts + to_seconds((event_id % 7) * 3600)) over (partition by user_id % 10 order by event_id) as \"at\" from events")
def monotone_clock(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("repo"), "event_id", F.expr("ts + make_dt_interval(0, 0, 0, (event_id % 7) * 3600)").alias("ct"))
    return arrivals.monotone_clock(e, "repo", "event_id", "ct").select("repo", "event_id", "at")


@query(
    f"""with {RECORDS}, b as (select *, lag(answer) over (partition by iid order by t) as before from records), ev as (select iid, t as "at" from records where action = 'rederive')
    select ev.iid, ev."at", count(*) as n_reads, count_if(not served_valid) as n_wrong, max(case when r.t = ev."at" then before is not null and answer <> before end) as affected
    from ev join b r on r.iid = ev.iid and r.t >= ev."at" and r.t < ev."at" + 10 group by 1, 2"""
)
def event_windows(spark, sf):
    """The ten reads from each re-derivation on."""
    r = base.records(spark, sf)
    return arrivals.event_windows(r.select("iid", "t", F.col("answer").alias("truth"), "served_valid"), r.where("action = 'rederive'").select("iid", F.col("t").alias("at")))


@query(
    """with f as (select distinct user_id % 10 as repo, user_id as iid, dense_rank() over (partition by user_id % 10 order by user_id) as rank from events),
    c as (select *, sum(1 / pow(rank, 1.1)) over (partition by repo order by rank) as upto, sum(1 / pow(rank, 1.1)) over (partition by repo) as al from f),
    g as (select repo, iid, coalesce(lag(upto) over (partition by repo order by rank), 0) / al as lo, upto / al as hi from c),
    d as (select user_id % 10 as repo, event_id as task, draw, ('0x' || substr(md5('zipf|' || event_id || '|' || draw), 1, 12))::bigint / 281474976710656.0::double as u from events, range(1, 65) r(draw) where event_type = 'click'),
    j as (select d.repo, task, iid, min(draw) as draw from d join g on d.repo = g.repo and u >= lo and u < hi group by 1, 2, 3), n as (select repo, task, iid, row_number() over (partition by repo, task order by draw) as n from j)
    select * from n where n <= 3"""
)
def zipf_task_generator(spark, sf):
    e = table(spark, sf, "events").withColumn("repo", F.col("user_id") % 10)
    f = e.select("repo", F.col("user_id").alias("iid")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy("iid")))
    return arrivals.zipf_tasks(f, e.where("event_type = 'click'").select("repo", F.col("event_id").alias("task")), 3, 1.1)


@query(
    """with s as (select doc_id % 3 as st, count(*) as ns, sum(quality) as v from labels group by 1), p as (select doc_id % 3 as st, count(*) as np from documents group by 1),
    w as (select ns, v, (np / sum(np) over ()) / (ns / sum(ns) over ()) as w from s join p using (st)) select sum(w * v) / sum(w * ns) as mean, pow(sum(w * ns), 2) / sum(w * w * ns) as effective_n from w"""
)
def post_strat_weights(spark, sf):
    s = table(spark, sf, "labels").withColumn("st", F.col("doc_id") % 3)
    return inference.post_stratified(s, table(spark, sf, "documents").withColumn("st", F.col("doc_id") % 3), "st", "quality")


@query(f"with {_FACTS}, g as (select iid % 8 as repo, sum(n_wrong) as a, sum(n_reads) as b from facts group by 1) select repo, (sum(a) over () - a) / greatest(sum(b) over () - b, 1) as ratio from g")
def leave_one_out_ratio(spark, sf):
    return inference.leave_one_out(records.per_fact(base.records(spark, sf)).withColumn("repo", F.col("iid") % 8), "repo", "n_wrong", "n_reads")


@query(f"with {_FACTS}, p as (select iid % 20 as k, sum(tok) as x, sum(n_wrong) as y from facts group by 1) select sum(sign(a.x - b.x) * sign(a.y - b.y)) / count(*) as tau, count(*) as pairs from p a join p b on a.k < b.k")
def kendall_tau(spark, sf):
    p = records.per_fact(base.records(spark, sf)).groupBy((F.col("iid") % 20).alias("k")).agg(F.sum("tok").alias("x"), F.sum("n_wrong").alias("y"))
    return inference.kendall(p, "k", "x", "y")


@query(f"with {_ISLANDS} select iid % 4 as g, quantile_cont(n_reads, 0.5) as p50, quantile_cont(n_reads, 0.9) as p90 from eps group by 1")
def percentile_lengths(spark, sf):
    return inference.percentiles(records.episodes(base.records(spark, sf)).withColumn("g", F.col("iid") % 4), ["g"], "n_reads")


_BOOT = """with {facts}, per as (select {unit} as u, sum(n_wrong) as a, sum(n_reads) as b from facts group by 1),
  h as (select r, a, b, ('0x' || substr(md5('boot|' || u || '|' || r), 1, 8))::bigint / 4294967296.0::double as x from per, range(1, 201) t(r)),
  w as (select r, a, b, case {steps} else 8 end as w from h), one as (select r, sum(w * a) / greatest(sum(w * b), 1) as x from w group by r)
  select (select sum(a) / greatest(sum(b), 1) from per) as ratio, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high from one"""


def _steps() -> str:
    import math

    total, out = 0.0, []
    for k in range(8):
        total += math.exp(-1.0) / math.factorial(k)
        out.append(f"when x < {total!r}::double then {k}")
    return " ".join(out)


@query(_BOOT.format(facts=_FACTS, unit="iid", steps=_steps()))
def bootstrap_ratio(spark, sf):
    return inference.bootstrap_ratio(records.per_fact(base.records(spark, sf)), "iid", "n_wrong", "n_reads")


@query(_BOOT.format(facts=_FACTS, unit="iid % 10", steps=_steps()))
def bootstrap_clusters(spark, sf):
    f = records.per_fact(base.records(spark, sf)).withColumn("repo", F.col("iid") % 10)
    return inference.bootstrap_ratio(f, "iid", "n_wrong", "n_reads", by="repo")


@query(f"with {_FACTS}, j as (select x.n_wrong - y.n_wrong as d from facts x join facts y on x.iid = y.iid + 1) select count(*) as n, avg(d) as mean_diff, count_if(d > 0) as wins, count_if(d < 0) as losses, count_if(d = 0) as ties from j")
def paired_difference(spark, sf):
    f = records.per_fact(base.records(spark, sf)).select("iid", "n_wrong")
    return inference.paired(f, f.select((F.col("iid") + 1).alias("iid"), "n_wrong"), "iid", "n_wrong")


@query("select date_trunc('day', ts)::timestamp as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_windows(spark, sf):
    return facade.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


@query(
    """with b as (select user_id, ts, case when ts < lag(ts) over w + interval 6 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from b) select user_id, min(ts) as start, max(ts) + interval 6 hours as "end", count(*) as n from s group by user_id, s"""
)
def session_windows(spark, sf):
    return facade.sessions(table(spark, sf, "events"), "ts", "user_id", "6 hours")


@query(f"with {LOG} select path, max_by(sha, idx) as sha, max(idx) as idx from (select * from log where sha is not null) group by path")
def late_corrections_manifest(spark, sf):
    return facade.latest_manifest(log(spark, sf).where("sha is not null").select("path", "idx", "sha"))


@query(
    """with p as (select doc_id, string_split(text, chr(10)) as a, string_split(lag(text) over (partition by source order by doc_id), chr(10)) as b from documents)
    select doc_id, len(list_distinct(list_filter(a, lambda x: not list_contains(b, x))))::integer as n_added, len(list_distinct(list_filter(b, lambda x: not list_contains(a, x))))::integer as n_removed from p where b is not null"""
)
def line_delta(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.lag("text").over(Window.partitionBy("source").orderBy("doc_id")).alias("old")).where("old is not null")
    return evidence.line_delta(d, "old", "text").select("doc_id", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query("select o_orderkey, substr(sha1(o_totalprice::decimal(20,2)::varchar), 1, 16) as value_hash from orders")
def value_hashes(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.value_hash(F.col("o_totalprice").cast("decimal(20,2)")).alias("value_hash"))
