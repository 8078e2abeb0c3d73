"""Read records: per-key metrics, episodes of wrong reads, causes, and their summaries.

A record is one read of one key under one policy: iid, t, stored_valid, served_valid,
flagged, action, eval_tok, der_tok, and optionally time. All are windows per key or one
aggregate per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar

ACTIONS = ("same", "memo", "valid", "none")


def _over(by: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy("t")


def per_fact(records: DataFrame, by: tuple[str, ...] = ("iid",)) -> DataFrame:
    """Counts of reads by kind and token sums per key, in one aggregate."""
    s, v, f = F.col("stored_valid"), F.col("served_valid"), F.col("flagged")
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_reads"),
        F.count_if(f & s).alias("n_false_flag"),
        F.count_if(~f & ~s).alias("n_false_silent"),
        F.count_if(s).alias("n_valid"),
        F.count_if(~s).alias("n_invalid"),
        F.count_if(~v).alias("n_wrong"),
        F.count_if(F.col("action") == "rederive").alias("n_rederive"),
        F.count_if(F.col("action") == "repair").alias("n_repair"),
        F.count_if((F.col("action") == "rederive") & s).alias("n_needless"),
        F.sum("eval_tok").alias("eval_tok"),
        F.sum("der_tok").alias("der_tok"),
        (F.sum("eval_tok") + F.sum("der_tok")).alias("tok"),
        F.bool_or(~v).alias("ever_wrong"),
    )


def summary(facts: DataFrame) -> DataFrame:
    """Ratios of sums over all keys; a zero denominator counts as 1."""
    r = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    n = F.count(F.lit(1))
    return facts.agg(
        r("n_false_flag", "n_valid").alias("false_flag_rate"),
        r("n_false_silent", "n_invalid").alias("false_silent_rate"),
        r("n_wrong", "n_reads").alias("served_wrong"),
        (F.sum("tok") / F.greatest(n, F.lit(1))).alias("tok_per_fact"),
        r("tok", "n_reads").alias("tok_per_read"),
        (F.sum("n_rederive") / F.greatest(n, F.lit(1))).alias("rederivations_per_fact"),
        r("n_needless", "n_rederive").alias("needless_share"),
        (F.count_if("ever_wrong") / F.greatest(n, F.lit(1))).alias("ever_wrong_share"),
    )


def group_mean(facts: DataFrame, group: str, num: str, den: str) -> DataFrame:
    """Mean of the groups' ratios, each group with equal weight."""
    per = facts.groupBy(group).agg((F.sum(num) / F.greatest(F.sum(den), F.lit(1))).alias("rate"))
    return per.agg(F.avg("rate").alias("mean_rate"), F.count(F.lit(1)).alias("n_groups"))


def islands(records: DataFrame) -> DataFrame:
    """Records with episode: the number (from 1) of the maximal run of wrong reads they lie in, null outside."""
    wrong = ~F.col("served_valid")
    start = wrong & ~F.coalesce(F.lag(wrong).over(_over(["iid"])), F.lit(False))
    number = F.sum(F.when(start, 1).otherwise(0)).over(_over(["iid"]).rowsBetween(Window.unboundedPreceding, 0))
    return records.withColumn("episode", F.when(wrong, number))


def episodes(records: DataFrame) -> DataFrame:
    """One row per episode: first and last read, length in reads, reads until the first flag (null: missed),
    and whether a right read ends it (else it is censored)."""
    rows = islands(records).withColumn("next_t", F.lead("t").over(_over(["iid"])))
    rows = rows.where("episode is not null").withColumn("pos", F.row_number().over(Window.partitionBy("iid", "episode").orderBy("t")) - 1)
    return rows.groupBy("iid", "episode").agg(
        F.min("t").alias("start_t"),
        F.max("t").alias("end_t"),
        F.count(F.lit(1)).alias("n_reads"),
        F.min(F.when(F.col("flagged"), F.col("pos"))).alias("delay"),
        F.max_by(F.col("next_t").isNull(), "t").alias("censored"),
    )


def episode_bins(eps: DataFrame) -> DataFrame:
    """Episodes by class of length."""
    n = F.col("n_reads")
    name = F.when(n <= 1, "1").when(n <= 2, "2").when(n <= 4, "3-4").otherwise("5+")
    return eps.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("delay").isNull()).alias("n_missed"))


def lifetime_kept(records: DataFrame) -> DataFrame:
    """Of the reads before a key's first invalid one, those served before any action."""
    w = Window.partitionBy("iid")
    invalid = F.min(F.when(~F.col("stored_valid"), F.col("t"))).over(w)
    action = F.min(F.when(~F.col("action").isin(*ACTIONS), F.col("t"))).over(w)
    rows = records.withColumn("first_invalid", invalid).withColumn("first_action", action)
    alive = F.col("first_invalid").isNull() | (F.col("t") < F.col("first_invalid"))
    return rows.groupBy("iid").agg(F.count_if(alive).alias("life"), F.count_if(alive & (F.col("first_action").isNull() | (F.col("t") < F.col("first_action")))).alias("kept"))


def taxonomy(records: DataFrame) -> DataFrame:
    """Each wrong read by its cause: what the last action that changed the answer left behind."""
    w = _over(["iid"]).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(~F.col("action").isin(*ACTIONS), F.struct("action", "served_valid", "t")), ignorenulls=True).over(w)
    rows = records.withColumn("last", last).where(~F.col("served_valid"))
    cause = (
        F.when(F.col("last").isNull(), "original_expired")
        .when((F.col("last.t") == F.col("t")), F.concat(F.lit("wrong_"), F.col("last.action")))
        .when(~F.col("last.served_valid"), F.concat(F.lit("kept_wrong_"), F.col("last.action")))
        .otherwise(F.concat(F.lit("expired_"), F.col("last.action")))
    )
    return rows.select("iid", "t", cause.alias("cause"))


def anchored_share(records: DataFrame) -> DataFrame:
    """Wrong reads in episodes that begin at a derivation or repair, of all wrong reads."""
    rows = islands(records).where("episode is not null")
    w = Window.partitionBy("iid", "episode").orderBy("t")
    rows = rows.withColumn("first", F.first("action").over(w))
    return rows.agg(F.count_if(F.col("first").isin("rederive", "repair")).alias("anchored"), F.count(F.lit(1)).alias("wrong"))


def consecutive_pairs(records: DataFrame) -> DataFrame:
    """Of a key's consecutive derivations: both wrong, and of these with the same answer."""
    rows = records.where(F.col("der_tok") > 0)
    nxt = F.lead(F.struct("served_valid", "answer")).over(_over(["iid"]))
    rows = rows.withColumn("next", nxt).where("next is not null")
    both = ~F.col("served_valid") & ~F.col("next.served_valid")
    return rows.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("served_valid")).alias("wrong_now"), F.count_if(both).alias("wrong_both"), F.count_if(both & (F.col("answer") == F.col("next.answer"))).alias("same_answer"))


def stale_windows(records: DataFrame) -> DataFrame:
    """Spells of staleness in real time: from the first wrong read to the next right one (censored: none)."""
    right = F.min(F.when(F.col("served_valid"), F.col("time"))).over(_over(["iid"]).rowsBetween(1, Window.unboundedFollowing))
    rows = islands(records).withColumn("until", right).where("episode is not null")
    return rows.groupBy("iid", "episode").agg(F.min("time").alias("since"), F.max("until").alias("until"), F.count(F.lit(1)).alias("n_reads"))


def none_runs(values: DataFrame) -> DataFrame:
    """Runs of NONE per key (iid, t, value): temporary when a value follows, else permanent."""
    gone = F.col("value") == "NONE"
    start = gone & ~F.coalesce(F.lag(gone).over(_over(["iid"])), F.lit(False))
    rows = values.withColumn("run", F.sum(F.when(start, 1).otherwise(0)).over(_over(["iid"]))).withColumn("next", F.lead("t").over(_over(["iid"])))
    rows = rows.where(gone).groupBy("iid", "run").agg(F.min("t").alias("start_t"), F.count(F.lit(1)).alias("n"), F.max_by(F.col("next").isNotNull(), "t").alias("temporary"))
    return rows.select("iid", "start_t", "n", "temporary")


def pareto(points: DataFrame, cost: str, error: str) -> DataFrame:
    """Points that no cheaper or equally cheap one matches in error. One row per policy: a small table."""
    w = Window.orderBy(cost, error).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(error).over(w)
    return points.withColumn("best", best).where(F.col("best").isNull() | (F.col(error) < F.col("best"))).drop("best")


def cheapest_near_best(points: DataFrame, cost: str, error: str, slack: float) -> DataFrame:
    """The frozen choice: of the points within ``slack`` of the least error, the cheapest."""
    best = points.agg(F.min(error).alias("least"))
    near = points.crossJoin(F.broadcast(best)).where(F.col(error) <= F.col("least") + slack)  # one row
    return near.orderBy(cost, error).limit(1).drop("least")


def thinned(records: DataFrame, k: int) -> DataFrame:
    """A sparser schedule read off a dense one."""
    return records.where(F.col("t") % k == 0)


def completeness(states: DataFrame) -> DataFrame:
    """Reads (truth_changed, state_changed, verdict) by how the change was met, crossed with whether the answer is NONE."""
    kind = (
        F.when(~F.col("truth_changed"), "unchanged")
        .when(~F.col("state_changed"), "blind")
        .when(F.col("verdict") == "still_valid", "judged_valid")
        .otherwise("caught")
    )
    return states.groupBy(kind.alias("kind")).agg(F.count_if("is_none").alias("n_none"), F.count_if(~F.col("is_none")).alias("n_present"))


def full(records: DataFrame) -> DataFrame:
    """per_fact() with episodes (number, missed, mean delay, longest) and lifetime (life, kept)."""
    eps = episodes(records).groupBy("iid").agg(F.count(F.lit(1)).alias("n_episodes"), F.count_if(F.col("delay").isNull()).alias("n_missed"), F.avg("delay").alias("mean_delay"), F.max("n_reads").alias("longest"))
    out = per_fact(records).join(lifetime_kept(records), "iid").join(eps, "iid", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_episodes", "n_missed", "longest")})


def episode_summary(facts: DataFrame) -> DataFrame:
    """Ratios of sums of full() facts: accuracy, repairs, missed episodes, lifetime kept."""
    r = lambda a, b: F.sum(a) / F.greatest(F.sum(b), F.lit(1))
    return facts.agg(
        (1 - r("n_wrong", "n_reads")).alias("accuracy"),
        (F.sum("n_repair") / F.greatest(F.sum(F.col("n_repair") + F.col("n_rederive")), F.lit(1))).alias("repair_rate"),
        r("n_missed", "n_episodes").alias("missed_share"),
        r("kept", "life").alias("lifetime_kept"),
    )


def episode_causes(records: DataFrame) -> DataFrame:
    """Episodes by the cause of their first wrong read and by how they ended: a right read of what action, or not (censored)."""
    rows = islands(records).withColumn("next_action", F.lead("action").over(_over(["iid"])))
    rows = rows.where("episode is not null").join(taxonomy(records), ["iid", "t"])
    one = rows.groupBy("iid", "episode").agg(F.min_by("cause", "t").alias("cause"), F.max_by(F.coalesce("next_action", F.lit("censored")), "t").alias("ended"), F.count(F.lit(1)).alias("n_reads"))
    return one.groupBy("cause", "ended").agg(F.count(F.lit(1)).alias("n_episodes"), F.sum("n_reads").alias("n_reads"))


def present(records: DataFrame, truth: DataFrame, value: str = "value") -> DataFrame:
    """Records whose referent exists: the truth (iid, t, value) isn't NONE."""
    return records.join(truth.where(F.col(value) != "NONE").select("iid", "t"), ["iid", "t"], "left_semi")


def trace_diagnostics(values: DataFrame) -> DataFrame:
    """values (iid, t, value) against each key's first one: share of later versions that differ, the first
    change, whether it only ever disappears, changes to another value, distinct later values."""
    w = Window.partitionBy("iid").orderBy("t")
    rows = values.withColumn("k", F.first("value").over(w)).withColumn("i", F.row_number().over(w)).where("i > 1")
    off, gone = F.col("value") != F.col("k"), F.col("value") == "NONE"
    return rows.groupBy("iid").agg(
        (F.count_if(off) / F.count(F.lit(1))).alias("invalid_frac"),
        F.min(F.when(off, F.col("t"))).alias("first_change"),
        (F.bool_or(off) & F.coalesce(F.bool_and(F.when(off, gone)), F.lit(True))).alias("only_gone"),
        F.count_if(off & ~gone).alias("n_other"),
        F.countDistinct("value").alias("n_values"),
    )


def keep_filter(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """Keys whose recorded answer (iid, answer) is the truth (iid, t, value) at the first version, with how
    many later versions there are, how many it stays valid at, and the first at which it isn't."""
    w = Window.partitionBy("iid").orderBy("t")
    rows = truth.join(answers, "iid").withColumn("ok", F.col("answer").eqNullSafe(F.col("value"))).withColumn("i", F.row_number().over(w))
    out = rows.groupBy("iid").agg(
        F.bool_or((F.col("i") == 1) & F.col("ok")).alias("kept"),
        F.count_if(F.col("i") > 1).alias("n_later"),
        F.count_if((F.col("i") > 1) & F.col("ok")).alias("n_valid"),
        F.min(F.when((F.col("i") > 1) & ~F.col("ok"), F.col("t"))).alias("first_invalid"),
    )
    return out.where("kept").drop("kept")


def valid_versions(derivations: DataFrame, truth: DataFrame) -> DataFrame:
    """Each recorded derivation (iid, t, answer) against the truth (iid, t, value) at all versions: at how many it
    holds. Truths are counted by value first, so that no derivation meets every version."""
    n = truth.groupBy("iid", F.col("value").alias("answer")).agg(F.count(F.lit(1)).alias("n_valid"))
    return derivations.join(n, ["iid", "answer"], "left").select("iid", "t", "answer", F.coalesce("n_valid", F.lit(0)).alias("n_valid"))


def churn_bins(facts: DataFrame) -> DataFrame:
    """Facts (n_invalid, cost_a, cost_b) by class of invalid versions, with the ratio of costs."""
    n = F.col("n_invalid")
    name = F.when(n == 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").otherwise("11+")
    per = facts.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n_facts"), F.sum("cost_a").alias("a"), F.sum("cost_b").alias("b"))
    return per.select("bin", "n_facts", (F.col("a") / F.greatest("b", F.lit(1))).alias("ratio"))


def first_calls(calls: DataFrame, by: list[str], order: str) -> DataFrame:
    """Calls without repeats, in their order: the first occurrence of each of a key's calls wins."""
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return calls.withColumn("__n", first).where("__n = 1").drop("__n")


def rederivation_accuracy(derivations: list[DataFrame], truth: DataFrame) -> DataFrame:
    """Derivations (iid, t, answer) of several policies, each (iid, t) once, by outcome against the truth (iid, t, value)."""
    rows = derivations[0]
    for d in derivations[1:]:
        rows = rows.unionByName(d)
    one = rows.groupBy("iid", "t").agg(F.min("answer").alias("answer"))
    j = one.join(truth, ["iid", "t"])
    kind = F.when(F.col("answer").isNull(), "no_answer").when(F.col("answer") == F.col("value"), "correct").when(F.col("value") == "NONE", "none").otherwise("changed")
    return j.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def stream_summary(records: DataFrame, policy: str, baseline, seeds: int = 10) -> DataFrame:
    """Per policy: reads and wrong reads per seed, wrong reads per 1000 tokens, and wrong reads avoided
    against the baseline policy per million tokens spent."""
    per = records.groupBy(policy).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("served_valid")).alias("wrong"), F.sum(F.col("eval_tok") + F.col("der_tok")).alias("tok"))
    base = F.max(F.when(F.col(policy) == baseline, F.col("wrong"))).over(Window.partitionBy())  # one row a policy
    per = per.withColumn("base", base)
    return per.select(
        policy,
        (F.col("n") / seeds).alias("reads"),
        (F.col("wrong") / seeds).alias("wrong"),
        (F.col("wrong") * 1000 / F.greatest("tok", F.lit(1))).alias("wrong_per_1k"),
        ((F.col("base") - F.col("wrong")) * 1_000_000 / F.greatest("tok", F.lit(1))).alias("avoided_per_1m"),
    )


def tool_cost(records: DataFrame, traces: DataFrame) -> DataFrame:
    """Per key: reads, and the lengths of the traces (iid, t, calls) of the derivations that were triggered."""
    j = records.join(traces, ["iid", "t"], "left")
    return j.groupBy("iid").agg(F.count(F.lit(1)).alias("n_reads"), F.sum(F.when(F.col("der_tok") > 0, F.coalesce(F.size("calls"), F.lit(0))).otherwise(0)).alias("n_calls"))


def memo_ablation(records: DataFrame) -> DataFrame:
    """What judging costs, and what it would without the memo (each remembered state judged again, at the
    mean cost of a judgement of its key)."""
    judged = F.when(F.col("eval_tok") > 0, F.col("eval_tok"))
    per = records.groupBy("iid").agg(F.sum("eval_tok").alias("eval_tok"), F.avg(judged).alias("mean"), F.count_if(F.col("action") == "memo").alias("n_memo"))
    return per.select("iid", "eval_tok", (F.col("eval_tok") + F.coalesce(F.col("mean"), F.lit(0.0)) * F.col("n_memo")).alias("without_memo"))


def expiry_segments(records: DataFrame, ages: list[int], chance: float) -> DataFrame:
    """Expiry at age N: in each segment between derivations (or up to the last read), how many expiries
    fall, and how many of them a re-derivation that errs with this chance is expected to get wrong."""
    last = F.max("t").over(Window.partitionBy("iid"))
    rows = records.withColumn("last", last).where(F.col("der_tok") > 0)
    rows = rows.withColumn("length", F.coalesce(F.lead("t").over(_over(["iid"])), F.col("last") + 1) - F.col("t"))
    rows = rows.select("length", F.explode(F.array(*map(F.lit, ages))).alias("age"))
    n = F.floor((F.col("length") - 1) / F.col("age"))
    return rows.groupBy("age").agg(F.count(F.lit(1)).alias("n_segments"), F.sum(n).alias("n_expiries"), (F.sum(n) * F.lit(chance)).alias("expected_wrong"))


def with_setup(facts: DataFrame, setup: DataFrame) -> DataFrame:
    """Facts (iid, tok) with the tokens of their certificate (iid, setup_tok) added once."""
    return facts.join(setup, "iid", "left").select("iid", (F.col("tok") + F.coalesce("setup_tok", F.lit(0))).alias("tok"))


def task_check(given, truth):
    """Outcome of a task's answer: fail without one, success if its canonical form is the truth, else wrong."""
    canon = scalar.canonical_answer(given, truth)
    return F.when(given.isNull() | (F.trim(given) == ""), "fail").when(canon.eqNullSafe(truth), "success").otherwise("wrong")
