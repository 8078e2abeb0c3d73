"""Queries of the analyses over read records: diagnostics, imputation, composed policies, intervals and tests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import arrivals, evidence, inference, observe, policies, records
from palimpsest.plans import base
from palimpsest.plans.base import FILES, RECORDS, files, query, table
from palimpsest.plans.maintenance import _FACTS, _ISLANDS, READS, _reads, _steps
from palimpsest.sources import sinks


def _records(spark, sf):
    return base.records(spark, sf)


TRUTH = RECORDS + ", truth as (select iid, t, case when action = 'same' and not served_valid then 'NONE' else answer end as value from records)"


def _truth(spark, sf):
    """Answers that hold, with NONE where an event is an error."""
    gone = (F.col("action") == "same") & ~F.col("served_valid")
    return _records(spark, sf).select("iid", "t", F.when(gone, "NONE").otherwise(F.col("answer")).alias("value"))


_LIFE = f"""{_ISLANDS}, {_FACTS.removeprefix(RECORDS).removeprefix(', ')},
  ml as (select *, min(t) filter (where not stored_valid) over (partition by iid) as fi, min(t) filter (where action not in ('same', 'memo', 'valid', 'none')) over (partition by iid) as fa from records),
  life as (select iid, count_if(fi is null or t < fi) as life, count_if((fi is null or t < fi) and (fa is null or t < fa)) as kept from ml group by iid),
  pe as (select iid, count(*) as n_episodes, count_if(delay is null) as n_missed, avg(delay) as mean_delay, max(n_reads) as longest from eps group by iid),
  fl as (select facts.*, life, kept, coalesce(n_episodes, 0) as n_episodes, coalesce(n_missed, 0) as n_missed, mean_delay, coalesce(longest, 0) as longest from facts join life using (iid) left join pe using (iid))"""


@query(f"with {_LIFE} select * from fl")
def per_fact_full(spark, sf):
    return records.full(_records(spark, sf))


@query(
    f"""with {_LIFE} select 1 - sum(n_wrong) / greatest(sum(n_reads), 1) as accuracy, sum(n_repair) / greatest(sum(n_repair + n_rederive), 1) as repair_rate,
    sum(n_missed) / greatest(sum(n_episodes), 1) as missed_share, sum(kept) / greatest(sum(life), 1) as lifetime_kept from fl"""
)
def episode_summary(spark, sf):
    return records.episode_summary(records.full(_records(spark, sf)))


@query(
    f"""with {_ISLANDS}, a as (select *, last_value(case when action not in ('same', 'memo') then t end ignore nulls) over w as lt, last_value(case when action not in ('same', 'memo') then action end ignore nulls) over w as la,
      last_value(case when action not in ('same', 'memo') then served_valid end ignore nulls) over w as lv, lead(action) over (partition by iid order by t) as na from i window w as (partition by iid order by t rows unbounded preceding)),
    c as (select *, case when lt is null then 'original_expired' when lt = t then 'wrong_' || la when not lv then 'kept_wrong_' || la else 'expired_' || la end as cause from a where not served_valid),
    g as (select iid, episode, min_by(cause, t) as cause, max_by(coalesce(na, 'censored'), t) as ended, count(*) as n_reads from c group by 1, 2)
    select cause, ended, count(*) as n_episodes, sum(n_reads)::bigint as n_reads from g group by 1, 2"""
)
def episode_causes(spark, sf):
    return records.episode_causes(_records(spark, sf))


@query(f"with {TRUTH} select iid, count(*) as n, count_if(not served_valid) as n_wrong from records join truth using (iid, t) where value <> 'NONE' group by iid")
def present_referents(spark, sf):
    r = records.present(_records(spark, sf), _truth(spark, sf))
    return r.groupBy("iid").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("served_valid")).alias("n_wrong"))


@query(
    f"""with {TRUTH}, k as (select *, first_value(value) over (partition by iid order by t) as k, row_number() over (partition by iid order by t) as i from truth)
    select iid, count_if(value <> k) / count(*) as invalid_frac, min(t) filter (where value <> k) as first_change, bool_or(value <> k) and coalesce(bool_and(value = 'NONE') filter (where value <> k), true) as only_gone,
      count_if(value <> k and value <> 'NONE') as n_other, count(distinct value) as n_values from k where i > 1 group by iid"""
)
def trace_diagnostics(spark, sf):
    return records.trace_diagnostics(_truth(spark, sf))


@query(
    f"""with {TRUTH}, r as (select *, 'a' || (iid % 3) = value as ok, row_number() over (partition by iid order by t) as i from truth)
    select iid, count_if(i > 1) as n_later, count_if(i > 1 and ok) as n_valid, min(t) filter (where i > 1 and not ok) as first_invalid from r group by iid having bool_or(i = 1 and ok)"""
)
def keep_filter(spark, sf):
    """Recorded answers, written as quoted text, that are the truth at the first version."""
    t = _truth(spark, sf)
    given = F.concat(F.lit('"a'), (F.col("iid") % 3).cast("string"), F.lit('"'))
    answers = t.select("iid").distinct().select("iid", scalar.canonical_answer(given, F.lit("x")).alias("answer"))
    return records.keep_filter(answers, t)


@query(f"with {TRUTH} select d.iid, d.t, d.answer, count(truth.t) as n_valid from (select iid, t, answer from records where der_tok > 0) d left join truth on truth.iid = d.iid and truth.value = d.answer group by 1, 2, 3")
def valid_versions(spark, sf):
    return records.valid_versions(_records(spark, sf).where("der_tok > 0").select("iid", "t", "answer"), _truth(spark, sf))


@query(f"with {TRUTH}, v as (select iid, count_if(value <> 'a' || (iid % 3)) as n_invalid from truth group by 1), c as (select iid, sum(eval_tok + der_tok) as a, sum(der_tok) as b from records group by 1) select case when n_invalid = 0 then '0' when n_invalid <= 5 then '1-5' when n_invalid <= 10 then '6-10' else '11+' end as bin, count(*) as n_facts, sum(a) / greatest(sum(b), 1) as ratio from v join c using (iid) group by 1")
def churn_bins(spark, sf):
    n = _truth(spark, sf).groupBy("iid").agg(F.count_if(F.col("value") != F.concat(F.lit("a"), (F.col("iid") % 3).cast("string"))).alias("n_invalid"))
    cost = _records(spark, sf).groupBy("iid").agg(F.sum(F.col("eval_tok") + F.col("der_tok")).alias("cost_a"), F.sum("der_tok").alias("cost_b"))
    return records.churn_bins(n.join(cost, "iid"))


@query("select user_id, event_id, props from (select *, row_number() over (partition by user_id, props order by event_id) as r from events) where r = 1")
def first_calls(spark, sf):
    return records.first_calls(table(spark, sf, "events").select("user_id", "event_id", "props"), ["user_id", "props"], "event_id")


@query(f"with {TRUTH}, d as (select iid, t, min(answer) as answer from records where action in ('rederive', 'repair') group by 1, 2) select case when answer is null then 'no_answer' when answer = value then 'correct' when value = 'NONE' then 'none' else 'changed' end as kind, count(*) as n from d join truth using (iid, t) group by 1")
def rederivation_accuracy(spark, sf):
    r = _records(spark, sf).select("iid", "t", "answer", "action")
    both = r.where("action in ('rederive', 'repair')").drop("action")
    return records.rederivation_accuracy([r.where("action = 'rederive'").drop("action"), both], _truth(spark, sf))


_POLICY = f"with {RECORDS}, p as (select iid % 20 as policy, count(*) as n, count_if(not served_valid) as wrong, sum(eval_tok + der_tok) as tok from records group by 1), b as (select *, max(case when policy = 0 then wrong end) over () as base from p)"


@query(f"{_POLICY} select policy, n / 10 as reads, wrong / 10 as wrong, wrong * 1000 / greatest(tok, 1) as wrong_per_1k, (base - wrong) * 1000000 / greatest(tok, 1) as avoided_per_1m from b")
def stream_summary(spark, sf):
    return records.stream_summary(_records(spark, sf).withColumn("policy", F.col("iid") % 20), "policy", 0)


@query("select user_id as iid, count(*) as n_reads, sum(case when event_type in ('signup', 'purchase') and floor(value) > 0 then 1 + event_id % 4 else 0 end)::bigint as n_calls from events group by 1")
def tool_cost(spark, sf):
    r = _records(spark, sf)
    calls = r.select("iid", "t", F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda i: F.concat(F.lit("call "), i.cast("string"))).alias("calls"))
    return records.tool_cost(r, calls)


@query(f"with {RECORDS} select iid, sum(eval_tok)::bigint as eval_tok, sum(eval_tok) + coalesce(avg(case when eval_tok > 0 then eval_tok end), 0) * count_if(action = 'memo') as without_memo from records group by iid")
def memo_ablation(spark, sf):
    return records.memo_ablation(_records(spark, sf))


@query(
    f"""with {RECORDS}, l as (select *, max(t) over (partition by iid) as last from records), s as (select coalesce(lead(t) over (partition by iid order by t), last + 1) - t as length from l where der_tok > 0)
    select age, count(*) as n_segments, sum((length - 1) // age)::bigint as n_expiries, sum((length - 1) // age) * 0.125::double as expected_wrong from s, (values (3), (7), (15)) a(age) group by age"""
)
def expiry_segments(spark, sf):
    return records.expiry_segments(_records(spark, sf), [3, 7, 15], 0.125)


@query(f"with {_FACTS} select iid, (tok + case when n_repair > 0 then 100 else 0 end)::bigint as tok from facts")
def setup_cost(spark, sf):
    f = records.per_fact(_records(spark, sf))
    return records.with_setup(f, f.where("n_repair > 0").select("iid", F.lit(100).cast("long").alias("setup_tok")))


@query("""with e as (select user_id, event_id, sha256('{"k":"' || user_id || '","v":"' || json_extract_string(props, '$.k') || '"}') as key, event_type from events), c as (select key, min(event_type) as response from e where event_type in ('click', 'view') group by 1)
    select event_id, key, coalesce(response, 'unsure') as response, response is not null as hit from e left join c using (key)""")
def response_cache(spark, sf):
    e = table(spark, sf, "events")
    r = e.select("event_id", "event_type", sinks.request_key(F.col("user_id").cast("string").alias("k"), F.get_json_object("props", "$.k").alias("v")).alias("key"))
    return sinks.cached(r.drop("event_type"), r.where("event_type in ('click', 'view')").select("key", F.col("event_type").alias("response")))


# composed policies, agreement, sweeps


@query(
    f"""with {RECORDS}, w as (select iid, t as u, answer as truth, coalesce(state <> lag(state) over (partition by iid order by t), true) as fired from records), d as (select iid, t, answer as dtruth, der_tok as tokens from records where der_tok > 0),
    j as (select w.iid, w.u, d.tokens, row_number() over (partition by w.iid, w.u order by (dtruth is distinct from truth), abs(d.t - w.u), d.t) as r from w left join d on w.iid = d.iid where fired),
    p as (select iid, count(*) as n_derived, sum(tokens) as tok from j where r = 1 group by 1), n as (select iid, count(*) as n_reads from records group by 1)
    select iid, n_reads, coalesce(n_derived, 0) as n_derived, coalesce(tok, 0)::bigint as tok from n left join p using (iid)"""
)
def composed_guard_cost(spark, sf):
    """A file-hash guard put together from records: where the state changes, the nearest derivation is paid."""
    r = _records(spark, sf)
    before = F.lag("state").over(Window.partitionBy("iid").orderBy("t"))
    triggers = r.select("iid", "t", F.coalesce(F.col("state") != before, F.lit(True)).alias("fired"))
    derivations = r.where("der_tok > 0").select("iid", "t", F.col("answer").alias("truth"), F.col("der_tok").alias("tokens"))
    return arrivals.composed_cost(r.select("iid", "t", F.col("answer").alias("truth")), triggers, derivations)


@query(
    f"""with {READS}, d as (select *, t % 5 = 0 or t = 1 as derived from reads), v as (select *, last_value(case when derived then truth end ignore nulls) over (partition by iid order by t rows unbounded preceding) as served from d),
    x as (select iid, t, served <> truth as wrong from v), y as (select iid, t, not served_valid as wrong from records where action <> 'memo')
    select count(y.wrong) as n, avg((x.wrong = y.wrong)::int) as agree, count_if(y.wrong is null) as only_engine, count_if(x.wrong is null) as only_recorded from x full join y using (iid, t)"""
)
def replay_agreement(spark, sf):
    """A simulated schedule of derivations against recorded reads."""
    engine = policies.served_at(_reads(spark, sf), F.col("t") % 5 == 0)
    recorded = _records(spark, sf).where("action <> 'memo'").select("iid", "t", (~F.col("served_valid")).alias("wrong"))
    return arrivals.agreement(engine, recorded, ["iid", "t"], "wrong")


@query(
    f"""with {READS}, c as (select k from (values (3), (7), (15)) v(k)), d as (select c.k, r.*, (t - 1) % c.k = 0 as derived from reads r, c),
    s as (select *, last_value(case when derived then truth end ignore nulls) over (partition by k, iid order by t rows unbounded preceding) as served from d)
    select k::bigint as k, every::bigint as every, count(*) as n_reads, count_if(served <> truth) as n_wrong, count_if(derived) as n_derived from s join (values (1), (5)) e(every) on t % every = 0 group by 1, 2"""
)
def expiry_sweep(spark, sf):
    """Ages of expiry and read schedules as columns of one job."""
    return policies.sweep(_reads(spark, sf), [3, 7, 15], [1, 5])


_ALL = [("never", "t = 1"), ("always", "true"), ("ttl_epoch7", "row_number() over (partition by iid, t // 7 order by t) = 1"), ("ttl_age7", "(t - 1) % 7 = 0"), ("replay", "coalesce(state <> lag(state) over (partition by iid order by t), true)")]
_EACH = ", ".join(f"s_{n} as (select *, last_value(case when derived then truth end ignore nulls) over (partition by iid order by t rows unbounded preceding) as served from (select *, {sql} as derived from reads))" for n, sql in _ALL)


@query(f"with {READS}, {_EACH} " + " union all ".join(f"select '{n}' as policy, count(*) as n_reads, count_if(served <> truth) as n_wrong, count_if(derived) as n_derived from s_{n}" for n, _ in _ALL))
def policy_table(spark, sf):
    """Named policies of the registry over the same reads."""
    rows, out = _reads(spark, sf), None
    for name, _ in _ALL:
        p = policies.run(name, rows).agg(F.lit(name).alias("policy"), F.count(F.lit(1)).alias("n_reads"), F.count_if("wrong").alias("n_wrong"), F.count_if("derived").alias("n_derived"))
        out = p if out is None else out.unionByName(p)
    return out


@query(f"with {READS} select iid, t from reads where t in ({', '.join(map(str, policies.bursty(400)))})")
def schedule_bursty(spark, sf):
    return policies.at_times(_reads(spark, sf), policies.bursty(400)).select("iid", "t")


_TASKS = "tasks as (select user_id % 10 as repo, ts as time from events where event_type = 'click'), commits as (select user_id % 10 as repo, ts as time from events where event_type = 'purchase')"


@query(f"with {_TASKS}, j as (select tasks.repo, epoch_us(tasks.time) - epoch_us(commits.time) as gap from tasks asof left join commits on tasks.repo = commits.repo and tasks.time >= commits.time) select repo, count(*) as n_tasks, count_if(gap <= 24 * 3600000000) / count(*) as within from j group by 1")
def near_commit_share(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 10).alias("repo"), F.col("ts").alias("time"), "event_type")
    return arrivals.after_commit(e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"), "repo")


@query("with c as (select user_id % 10 as repo, count(*) as n from events where event_type = 'click' group by 1), i as (select repo, unnest(range(1, n + 1)) as i from c) select repo, i::integer as i, 1000000.0::double + ('0x' || substr(md5('poisson|' || repo || '|' || i), 1, 8))::bigint / 4294967296.0::double * 2000000.0::double as \"at\" from i")
def poisson_control(spark, sf):
    c = table(spark, sf, "events").where("event_type = 'click'").groupBy((F.col("user_id") % 10).alias("repo")).agg(F.count(F.lit(1)).alias("n"))
    return arrivals.poisson_control(c, "repo", 1_000_000, 3_000_000)


# evidence


@query("select doc_id as iid, 1::bigint as t, [list_bool_or(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ') = 'the' or contains(x, 'licensed under'))), list_bool_or(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ') = 'the'))] as present from documents where text is not null")
def evidence_citations(spark, sf):
    """Whether a long cite stands in a text, or a short one makes a line of it."""
    d = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("iid"), F.lit(1).cast("long").alias("t"), "text")
    cites = d.select("iid", F.explode(F.array(F.lit("licensed under"), F.lit("the"))).alias("cite"))
    return evidence.citations(d, cites)


_LN = "ln as (select doc_id::varchar as path, unnest(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10))) as line, generate_subscripts(string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)), 1) as line_no from documents)"
_AN = "an as (select path, line as cite, min(line_no) as line_at from ln where length(line) >= 6 group by 1, 2 having count(*) = 1), fl as (select path, min_by(cite, line_at) as first, max_by(cite, line_at) as last, 3 as pos from an group by 1)"


@query(f"with {_LN}, {_AN} select fl.path, (select min_by(line_no, abs(line_no - fl.pos)) from ln where ln.path = fl.path and ln.line = fl.first)::integer as start_line, (select min_by(line_no, abs(line_no - fl.pos)) from ln where ln.path = fl.path and ln.line = fl.last)::integer as end_line from fl")
def content_spans(spark, sf):
    """Spans between the first and the last distinctive line of each text, found again by content."""
    texts = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    return evidence.spans(texts, evidence.span_anchors(texts).withColumn("at", F.lit(3)))


@query(f"with {READS}, v as (select state, min(case when t % 2 = 0 then 'still_valid' else 'changed' end) as verdict from reads where state <> 's3' group by 1) select iid, t, coalesce(verdict, 'unsure') as verdict from reads left join v using (state)")
def verdict_join(spark, sf):
    r = _reads(spark, sf).drop("verdict")
    told = r.where("state <> 's3'").groupBy("state").agg(F.min(F.when(F.col("t") % 2 == 0, "still_valid").otherwise("changed")).alias("verdict"))
    return evidence.verdicts(r, told, ["state"]).select("iid", "t", "verdict")


@query("with s as (select user_id, event_type as v, count(*) as n from events group by 1, 2), a as (select *, sum(n) over (partition by user_id) as al from s) select user_id, coalesce(max(case when n * 2 > al then v end), 'unsure') as verdict from a group by 1")
def combined_samples(spark, sf):
    return evidence.combine_samples(table(spark, sf, "events").select("user_id", F.col("event_type").alias("verdict")), ["user_id"])


@query(
    f"""with {TRUTH}, l as (select r.iid, r.t, value, value is distinct from lag(value) over w as tc, state is distinct from lag(state) over w as sc, row_number() over w as i, ['still_valid', 'changed', 'unsure'][event_id % 3 + 1] as verdict from records r join truth using (iid, t) window w as (partition by r.iid order by r.t))
    select case when not tc then 'unchanged' when not sc then 'blind' when verdict = 'still_valid' then 'judged_valid' else 'caught' end as kind, count_if(value = 'NONE') as n_none, count_if(value <> 'NONE') as n_present from l where i > 1 group by 1"""
)
def observation_completeness(spark, sf):
    r = _records(spark, sf).join(_truth(spark, sf), ["iid", "t"])
    w = Window.partitionBy("iid").orderBy("t")
    verdict = F.element_at(F.array(F.lit("still_valid"), F.lit("changed"), F.lit("unsure")), ((F.col("event_id") % 3) + 1).cast("int"))
    moved = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w))
    rows = r.select(moved("value").alias("truth_changed"), moved("state").alias("state_changed"), verdict.alias("verdict"), (F.col("value") == "NONE").alias("is_none"), F.row_number().over(w).alias("i"))
    return records.completeness(rows.where("i > 1"))


@query(f"with {_LN}, h as (select path, line_no, line, row_number() over (partition by path order by line_no) as n from ln where contains(line, 'the ')) select path, line_no::integer as line_no, line from h where n <= 8")
def auto_citations(spark, sf):
    """The first eight lines of each text that hold an item of the answer."""
    texts = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), "text")
    return evidence.auto_citations(texts, texts.select("path", F.lit("the ").alias("item")))


@query("with b as (select hash_.*, row_number() over (partition by source order by doc_id) as i from (select source, doc_id, least(length(coalesce(text, '')), 12288) as size from documents) hash_), r as (select source, max(i) as n from b group by 1) select source, n as n_items from r")
def grouped_items(spark, sf):
    """How many items the groups of at most 12 KB hold together, per source."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(12288)).alias("size"))
    return evidence.capped_groups(d, "source", "doc_id", "size", 12288).groupBy("source").agg(F.sum("n_items").cast("long").alias("n_items"))


# texts


@query("select doc_id, array_to_string(list_sort(list_distinct(string_split(text, chr(10)))), chr(10)) as text from documents where text is not null")
def unique_lines(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", scalar.unique_lines(F.col("text")).alias("text"))


@query("select event_id, event_type || ':' || props as line from events")
def unnumbered_lines(spark, sf):
    """Search results without the numbers of their lines."""
    e = table(spark, sf, "events")
    return e.select("event_id", scalar.without_line_numbers(F.concat_ws(":", "event_type", F.col("event_id").cast("string"), "props")).alias("line"))


@query(f"with {FILES} select path from files")
def normal_paths(spark, sf):
    """Paths as they are written in answers: quoted, blank, with ./ before."""
    f = files(spark, sf)
    return f.select(scalar.normal_path(F.concat(F.lit(' "./'), "path", F.lit('" '))).alias("path"))


@query("select c_custkey, abs(ln((c_custkey + 1)::double / (c_nationkey + 1))) as distance from customer")
def rate_distances(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.rate_distance((F.col("c_custkey") + 1).cast("double"), F.col("c_nationkey") + 1).alias("distance"))


@query("select c_custkey, printf('%.10g', c_acctbal) as text from customer")
def float_texts(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", scalar.float_text(F.col("c_acctbal")).alias("text"))


@query("select event_id, case event_type when 'click' then 'tests' when 'view' then 'docs' else 'pkg' end || '/' || case when user_id % 2 = 0 then 'test_' else '' end || 'm' || user_id || case when event_type = 'error' then '.md' else '.py' end as path, event_type = 'click' or (user_id % 2 = 0 and event_type <> 'error') as test, event_type in ('purchase', 'signup') and user_id % 2 = 1 as source from events")
def path_kinds(spark, sf):
    e = table(spark, sf, "events")
    folder = F.when(F.col("event_type") == "click", "tests").when(F.col("event_type") == "view", "docs").otherwise("pkg")
    path = F.concat(folder, F.lit("/"), F.when(F.col("user_id") % 2 == 0, "test_").otherwise(""), F.lit("m"), F.col("user_id").cast("string"), F.when(F.col("event_type") == "error", ".md").otherwise(".py"))
    return e.select("event_id", path.alias("path")).select("event_id", "path", scalar.is_test(F.col("path")).alias("test"), scalar.is_source(F.col("path")).alias("source"))


@query("select event_id, case when event_type = 'error' then 'PARSE_ERROR' else user_id::varchar end as ini, case when event_type = 'error' then 'PARSE_ERROR' else '\"' || event_type || '\"' end as toml from events")
def config_values(spark, sf):
    """Values of INI and TOML texts; a broken text gives a mark of its own."""
    e = table(spark, sf, "events")
    broken = F.when(F.col("event_type") == "error", "no section\n").otherwise("")
    ini = F.concat(broken, F.lit("[user]\nid = "), F.col("user_id").cast("string"), F.lit("\n"))
    toml = F.concat(broken, F.lit('[event]\nkind = "'), "event_type", F.lit('"\n'))
    return e.select("event_id", scalar.ini_value(ini, "user", "id").alias("ini"), scalar.toml_value(toml, "event.kind").alias("toml"))


@query("select o_orderkey, 'In the data of ' || strftime(o_orderdate, '%Y-%m') || ', what is the count of orders with status ' || o_orderstatus || '?' as question from orders")
def fact_questions(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.question(scalar.month_of(F.col("o_orderdate")), F.lit("count"), F.lit("orders with status "), F.col("o_orderstatus")).alias("question"))


@query("select event_id, case event_type when 'click' then 'grep(' || user_id || ')' when 'view' then 'read_text(' || user_id || ')' else event_type || '(' || user_id || ')' end as label from events")
def call_labels(spark, sf):
    e = table(spark, sf, "events")
    tool = F.when(F.col("event_type") == "click", "grep").when(F.col("event_type") == "view", "read_text").otherwise(F.col("event_type"))
    return e.select("event_id", observe.label(tool, F.col("user_id").cast("string")).alias("label"))


@query(f"with {RECORDS}, v as (select distinct iid, substr(sha1(answer), 1, 16) as value_hash, answer as value from records) select r.iid, r.t, v.value from (select iid, t, substr(sha1(answer), 1, 16) as value_hash from records) r join v using (iid, value_hash)")
def decode_values(spark, sf):
    """Values that records hold as hashes, decoded by a dictionary per key."""
    r = _records(spark, sf).select("iid", "t", "answer", scalar.value_hash(F.col("answer")).alias("value_hash"))
    return evidence.decode(r.drop("answer"), r.select("iid", "value_hash", F.col("answer").alias("value")).distinct()).select("iid", "t", "value")


# statistics


def _boot(per: str, seed: str, replicates: int, out: str) -> str:
    """SQL of hash-weighted replicates: per gives u, a, b."""
    return f"""per as ({per}), h as (select r, a, b, ('0x' || substr(md5('{seed}|' || u || '|' || r), 1, 8))::bigint / 4294967296.0::double as x from per, range(1, {replicates + 1}) t(r)),
  wt as (select r, a, b, case {_steps()} else 8 end as w from h), one as (select r, sum(w * a) / greatest(sum(w * b), 1) as x from wt group by r) select {out} from one"""


_Q = lambda q, name: f"quantile_cont(x, {q}) as {name}"
_MEAN = "(select sum(a) / greatest(sum(b), 1) from per) as "
_DIFF = f"{_FACTS}, df as (select x.iid, x.n_wrong - y.n_wrong as d from facts x join facts y on x.iid = y.iid + 1)"
_BANDS = ", ".join([_Q(0.025, "low95"), _Q(0.975, "high95"), _Q(0.05, "low90"), _Q(0.95, "high90")])


def _differences(spark, sf):
    f = records.per_fact(_records(spark, sf)).select("iid", "n_wrong")
    return inference.differences(f, f.select((F.col("iid") + 1).alias("iid"), "n_wrong"), "iid", "n_wrong")


@query(f"with {_FACTS}, {_boot('select iid as u, sum(n_wrong) as a, sum(n_reads) as b from facts group by 1', 'boot', 1000, _MEAN + 'ratio, ' + _Q(0.025, 'low') + ', ' + _Q(0.975, 'high'))}")
def bootstrap_ratio_1000(spark, sf):
    return inference.bootstrap_ratio(records.per_fact(_records(spark, sf)), "iid", "n_wrong", "n_reads", replicates=1000)


@query(f"with {_DIFF}, {_boot('select iid as u, sum(d) as a, count(*) as b from df group by 1', 'boot', 1000, _MEAN + 'mean, ' + _BANDS)}")
def paired_interval(spark, sf):
    return inference.bootstrap_mean(_differences(spark, sf), "iid", "d")


@query(f"with {_DIFF}, {_boot('select iid % 10 as u, sum(d) as a, count(*) as b from df group by 1', 'boot', 1000, _MEAN + 'mean, ' + _BANDS)}")
def paired_interval_clusters(spark, sf):
    d = _differences(spark, sf).withColumn("cluster", F.col("iid") % 10)
    return inference.bootstrap_mean(d, "cluster", "d")


@query(f"with {_DIFF}, m as (select iid % 10 as u, avg(d) as a, 1 as b from df group by 1), {_boot('select u, a, b from m', 'boot', 1000, _MEAN + 'mean, ' + _BANDS)}")
def cluster_mean_interval(spark, sf):
    """Every cluster counts the same: the interval of the mean of cluster means."""
    d = _differences(spark, sf).groupBy((F.col("iid") % 10).alias("cluster")).agg(F.avg("d").alias("d"))
    return inference.bootstrap_mean(d, "cluster", "d")


@query(
    f"""with {_DIFF}, c as (select abs(d) as x, count(*) as n, count_if(d > 0) as up from df where d <> 0 group by 1), r as (select *, sum(n) over (order by x) - n + (n + 1) / 2 as rank from c),
    s as (select sum(n) as n, sum(rank * up) as w_plus, sum(rank * (n - up)) as w_minus, sum(n * n * n - n) as ties from r) select n::bigint as n, w_plus, w_minus, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) as z from s"""
)
def wilcoxon_signed_rank(spark, sf):
    return inference.wilcoxon(_differences(spark, sf))


_CI = _boot("select iid as u, sum(d) as a, count(*) as b from df group by 1", "boot", 1000, _Q(0.05, "lo") + ", " + _Q(0.95, "hi"))


@query(f"with {_DIFF}, ci as (with {_CI}) select m as margin, hi < m as non_inferior, hi < m and lo > -m as equivalent from ci, (values (0.5::double), (1.0), (3.0)) v(m)")
def equivalence_margins(spark, sf):
    """Non-inferiority and two one-sided tests at several margins."""
    return inference.margins(inference.bootstrap_mean(_differences(spark, sf), "iid", "d"), [0.5, 1.0, 3.0])


@query(
    f"""with {_FACTS}, f as (select iid % 3 as st, iid, n_wrong from facts), p as (select user_id % 3 as st, count(*) / sum(count(*)) over () as share from events group by 1),
    h as (select r, st, n_wrong, case when r = 0 then -1 else ('0x' || substr(md5('strata|' || iid || '|' || r), 1, 8))::bigint / 4294967296.0::double end as x from f, range(0, 1001) t(r)),
    w as (select r, st, n_wrong, case when r = 0 then 1 else (case {_steps()} else 8 end) end as w from h), m as (select r, st, sum(w * n_wrong) / greatest(sum(w), 1) as m from w group by 1, 2),
    one as (select r, sum(share * m) / sum(share) as x from m join p using (st) group by 1) select max(x) filter (where r = 0) as mean, quantile_cont(x, 0.025) filter (where r > 0) as low, quantile_cont(x, 0.975) filter (where r > 0) as high from one"""
)
def stratified_bootstrap(spark, sf):
    f = records.per_fact(_records(spark, sf)).withColumn("st", F.col("iid") % 3)
    return inference.stratified_bootstrap(f, table(spark, sf, "events").withColumn("st", F.col("user_id") % 3), "st", "iid", "n_wrong")


@query(f"with {_FACTS}, {_boot('select iid as u, sum(der_tok) as a, sum(eval_tok) as b from facts group by 1', 'boot', 1000, _MEAN + 'ratio, ' + _Q(0.025, 'low') + ', ' + _Q(0.975, 'high'))}")
def cost_ratio_interval(spark, sf):
    return inference.bootstrap_quotient(records.per_fact(_records(spark, sf)), "iid", "der_tok", "eval_tok")


@query(
    f"""with {_FACTS}, p as (select iid % 20 as policy, sum(tok) as tok, sum(n_rederive + n_repair) as tools from facts group by 1), d as (select a.policy, a.tok - b.tok as dt, b.tools - a.tools as dc from p a, p b where b.policy = 0 and a.policy <> 0),
    c as (select *, case when dt <= 0 and dc >= 0 then 'always' when dt >= 0 and dc <= 0 then 'never' when dc > 0 then 'above' else 'below' end as cheaper from d) select policy, cheaper, case when cheaper in ('above', 'below') then dt / dc end as weight from c"""
)
def break_even_weights(spark, sf):
    p = records.per_fact(_records(spark, sf)).groupBy((F.col("iid") % 20).alias("policy")).agg(F.sum("tok").alias("tok"), F.sum(F.col("n_rederive") + F.col("n_repair")).alias("tools"))
    return inference.break_even(p, "policy", "tok", "tools", 0)


_OUT = "o as (select user_id as tid, event_type as arm, case when bool_or(value < 5) then 'fail' when avg(value) > 30 then 'wrong' else 'success' end as outcome from events where event_type in ('click', 'view') group by 1, 2)"


def _outcomes(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('click', 'view')")
    return e.groupBy(F.col("user_id").alias("tid"), F.col("event_type").alias("arm")).agg(F.when(F.bool_or(F.col("value") < 5), "fail").when(F.avg("value") > 30, "wrong").otherwise("success").alias("outcome"))


@query(f"with {_OUT} select arm, count(*) as n, count_if(outcome = 'success') / count(*) as success, count_if(outcome = 'wrong') / count(*) as wrong, count_if(outcome = 'fail') / count(*) as fail from o group by 1")
def task_outcomes(spark, sf):
    rate = lambda x: (F.count_if(F.col("outcome") == x) / F.count(F.lit(1))).alias(x)
    return _outcomes(spark, sf).groupBy("arm").agg(F.count(F.lit(1)).alias("n"), *map(rate, ("success", "wrong", "fail")))


@query(f"with {_OUT}, pv as (select tid, max(case when arm = 'click' then (outcome = 'success')::int end) - max(case when arm = 'view' then (outcome = 'success')::int end) as d from o group by 1), {_boot('select tid % 10 as u, sum(d) as a, count(*) as b from pv where d is not null group by 1', 'boot', 1000, _MEAN + 'mean, ' + _BANDS)}")
def task_arm_difference(spark, sf):
    """Difference of success between two arms of the same tasks, with intervals over clusters of tasks."""
    p = _outcomes(spark, sf).groupBy("tid").pivot("arm", ["click", "view"]).agg(F.max((F.col("outcome") == "success").cast("int")))
    d = p.select((F.col("tid") % 10).alias("cluster"), (F.col("click") - F.col("view")).alias("d")).where("d is not null")
    return inference.bootstrap_mean(d, "cluster", "d")
