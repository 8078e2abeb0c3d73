"""Task arrivals against a clock of versions: as-of joins, coalesced costs, imputation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from palimpsest.sources.working import kept


def _slice(rows: DataFrame, time: str, width: int = 4096):
    """The day of a time, or a run of numbers: what a key's rows are cut into, so that a hot key is no single task's."""
    number = isinstance(rows.schema[time].dataType, NumericType)
    return F.floor(F.col(time) / width) if number else F.to_date(F.col(time))


def asof(tasks: DataFrame, clock: DataFrame, by: str, time: str = "time", value: str = "t") -> DataFrame:
    """tasks with the value of the last clock row at or before their time, per key.

    A union and a window per key and day; what a day starts with comes from a window over one
    row a key and day. Neither side is repeated, and no task sees a whole key.
    """
    c = clock.select(by, F.col(time), F.lit(0).alias("__k"), F.col(value).alias("__v"), *[F.lit(None).cast(tasks.schema[x].dataType).alias(x) for x in tasks.columns if x not in (by, time)])
    x = tasks.select(by, time, F.lit(1).alias("__k"), F.lit(None).cast(clock.schema[value].dataType).alias("__v"), *[x for x in tasks.columns if x not in (by, time)])
    rows = c.unionByName(x)
    rows = rows.withColumn("__d", _slice(rows, time))
    w = Window.partitionBy(by, "__d").orderBy(time, "__k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.last("__v", ignorenulls=True).over(w))
    days = rows.groupBy(F.col(by).alias("__by"), F.col("__d").alias("__day")).agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(time))).alias("__end"))
    before = Window.partitionBy("__by").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__start", F.last("__end", ignorenulls=True).over(before))
    rows = rows.where("__k = 1").join(days, (F.col(by) == F.col("__by")) & (F.col("__d") == F.col("__day")))
    return rows.withColumn(value, F.coalesce("__here", "__start")).drop("__k", "__v", "__d", "__here", "__by", "__day", "__end", "__start")


def lazy_cost(reads: DataFrame, costs: DataFrame) -> DataFrame:
    """reads (iid, t, time) of lazily kept answers: the first read of a version pays what the versions
    since the last read version would cost when coalesced: the last judgement and the last derivation.
    costs: iid, t, eval_tok, der_tok."""
    w = Window.partitionBy("iid").orderBy("t")
    c = costs.select(
        "iid",
        "t",
        F.sum(F.col("eval_tok") + F.col("der_tok")).over(w).alias("upto"),
        F.max(F.when(F.col("eval_tok") > 0, F.col("t")).otherwise(0)).over(w).alias("last_eval"),
        F.max(F.when(F.col("der_tok") > 0, F.col("t")).otherwise(0)).over(w).alias("last_der"),
    )
    first = reads.groupBy("iid", "t").agg(F.min("time").alias("time"))
    first = first.withColumn("p", F.coalesce(F.lag("t").over(Window.partitionBy("iid").orderBy("t")), F.lit(0)))
    j = first.join(c, ["iid", "t"], "left")
    before = c.select("iid", F.col("t").alias("p"), F.col("upto").alias("upto_p"))
    j = j.join(before, ["iid", "p"], "left")
    e = costs.select("iid", F.col("t").alias("last_eval"), F.col("eval_tok").alias("judge_tok"))
    d = costs.select("iid", F.col("t").alias("last_der"), F.col("der_tok").alias("derive_tok"))
    j = j.join(e, ["iid", "last_eval"], "left").join(d, ["iid", "last_der"], "left")
    judged = F.when((F.col("last_eval") > F.col("p")) & (F.col("last_eval") > 0), F.col("judge_tok")).otherwise(0)
    derived = F.when((F.col("last_der") > F.col("p")) & (F.col("last_der") > 0), F.col("derive_tok")).otherwise(0)
    return j.select("iid", "t", "p", (F.coalesce(judged, F.lit(0)) + F.coalesce(derived, F.lit(0))).alias("lazy_tok"), (F.coalesce("upto", F.lit(0)) - F.coalesce("upto_p", F.lit(0))).alias("sum_tok"))


def eager_cost(costs: DataFrame) -> DataFrame:
    """Per key, the cost of following every version."""
    return costs.groupBy("iid").agg(F.sum(F.col("eval_tok") + F.col("der_tok")).alias("eager_tok"), F.count_if(F.col("der_tok") > 0).alias("n_derived"))


def impute_nearest(wanted: DataFrame, derivations: DataFrame) -> DataFrame:
    """wanted (iid, u, truth) to the recorded derivation (iid, t, truth, tokens) that stands for it: one of
    the same truth first, then the nearest in versions, then the earlier.

    Both sides in one order of versions: windows give the last derivation before each wanted row and
    the first one after it, of its truth and of any; no wanted row meets more than these four.
    """
    d = F.struct("t", "tokens", "truth")
    rows = derivations.select("iid", "t", "truth", "tokens", F.lit(True).alias("der")).unionByName(
        wanted.select("iid", F.col("u").alias("t"), "truth", F.lit(None).cast(derivations.schema["tokens"].dataType).alias("tokens"), F.lit(False).alias("der"))
    )
    held = F.when(F.col("der"), d)
    for name, keys in (("same", ["iid", "truth"]), ("any", ["iid"])):
        w = Window.partitionBy(*keys).orderBy("t")
        rows = rows.withColumn(f"{name}0", F.last(held, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn(f"{name}1", F.first(held, ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing)))
    rows = rows.where("not der")

    def nearer(name: str):
        a, b = F.col(f"{name}0"), F.col(f"{name}1")
        return F.when(a.isNull() | (F.col("t") - a["t"] > b["t"] - F.col("t")), F.coalesce(b, a)).otherwise(a)

    got = rows.withColumn("d", F.coalesce(nearer("same"), nearer("any")))
    kind = F.when(F.col("d.t").isNull(), "none").when(F.col("d.t") == F.col("t"), "exact").when(F.col("d.truth").eqNullSafe(F.col("truth")), "same_truth").otherwise("other_truth")
    return got.select("iid", F.col("t").alias("u"), F.col("d.t").alias("t"), F.col("d.tokens").alias("tokens"), kind.alias("kind"))


def interarrival(events: DataFrame, by: str, time: str = "time") -> DataFrame:
    """Gaps between a key's events in seconds: number, mean, coefficient of variation."""
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(Window.partitionBy(by).orderBy(time)).cast("timestamp"))
    g = events.withColumn("gap", gap / 1_000_000).where("gap is not null")
    return g.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), (F.stddev_pop("gap") / F.avg("gap")).alias("cv"))


def monotone_clock(commits: DataFrame, by: str, order: str, ct: str, width: int = 4096) -> DataFrame:
    """Commit times made monotone by a running maximum over a whole-number order.

    A window per key and run of ``width`` numbers, and one over the greatest time of each run.
    """
    rows = commits.withColumn("__r", F.floor(F.col(order) / width))
    runs = rows.groupBy(F.col(by).alias("__by"), F.col("__r").alias("__run")).agg(F.max(ct).alias("__most"))
    before = Window.partitionBy("__by").orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__start", F.max("__most").over(before))
    w = Window.partitionBy(by, "__r").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__here", F.max(ct).over(w)).join(runs, (F.col(by) == F.col("__by")) & (F.col("__r") == F.col("__run")))
    return rows.withColumn("at", F.greatest("__here", "__start")).drop("__r", "__here", "__by", "__run", "__most", "__start")


def task_rollup(reads: DataFrame, task: str, group: str) -> DataFrame:
    """A task is wrong as soon as one of its reads is; counts per group."""
    per = reads.groupBy(group, task).agg(F.bool_and("served_valid").alias("right"))
    return per.groupBy(group).agg(F.count(F.lit(1)).alias("n_tasks"), F.count_if(~F.col("right")).alias("n_wrong"))


#: Cells of the unit interval by which draws meet the facts that they may hit.
CELLS = 1024


#: Draws after which a task's remaining places go by a race instead.
MOST_DRAWS = 1024


def zipf_tasks(facts: DataFrame, tasks: DataFrame, k: int, s: float, seed: str = "zipf") -> DataFrame:
    """k distinct facts for every task (all, if a repository has fewer), drawn by a Zipf law over ranks.
    facts: repo, iid, rank (from 1); tasks: repo, task.

    Hashed numbers of a task are turned into ranks by the inverse of the law's distribution until k facts are
    found, which draws without replacement. Most tasks are done after a few numbers; only those that aren't draw
    on, four times as many each round. Where a few facts hold nearly all the weight, even that may not find k:
    after MOST_DRAWS numbers the places that are left go by an exponential race among the task's facts that weren't
    found, which has the same law. A number meets the facts of its cell of the unit interval alone.
    """
    weight = 1 / F.pow(F.col("rank"), F.lit(s))
    f = facts.withColumn("w", weight)
    upto = F.sum("w").over(Window.partitionBy("repo").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    f = f.withColumn("upto", upto).withColumn("all", F.sum("w").over(Window.partitionBy("repo")))
    f = f.withColumn("before", F.lag("upto", 1, 0.0).over(Window.partitionBy("repo").orderBy("rank")))
    f = f.select("repo", "iid", "w", (F.col("before") / F.col("all")).alias("lo"), (F.col("upto") / F.col("all")).alias("hi"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    f = kept(f.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi"))))))
    unit = lambda *x: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *x)), 1, 12), 16, 10).cast("double") / float(16**12)
    text = lambda c: F.col(c).cast("string")
    goal = f.groupBy("repo").agg(F.least(F.countDistinct("iid"), F.lit(k)).alias("goal"))
    open_, done, last, many = kept(tasks.select("repo", "task").distinct().join(goal, "repo")), [], 0, 4 * k
    found = None
    while True:
        d = open_.select("repo", "task", F.explode(F.sequence(F.lit(last + 1), F.lit(many))).alias("draw")).withColumn("u", unit(text("task"), text("draw"))).withColumn("cell", cell(F.col("u")))
        hit = d.join(f, ["repo", "cell"]).where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("repo", "task", "iid", "draw")
        seen = (hit if found is None else hit.unionByName(found)).groupBy("repo", "task", "iid").agg(F.min("draw").alias("draw"))
        have = Window.partitionBy("repo", "task")
        told = kept(seen.withColumn("have", F.count(F.lit(1)).over(have)).join(goal, "repo"))
        done.append(told.where("have >= goal").select("repo", "task", "iid", "draw"))
        short = open_.join(told.where("have >= goal").select("repo", "task").distinct(), ["repo", "task"], "left_anti")
        open_, found = kept(short), told.where("have < goal").select("repo", "task", "iid", "draw")
        if open_.isEmpty():
            break
        if many >= MOST_DRAWS:
            rest = open_.join(f.select("repo", "iid", "w").distinct(), "repo").join(found.select("repo", "task", "iid"), ["repo", "task", "iid"], "left_anti")
            race = -F.log(1 - unit(text("task"), text("iid"), F.lit("race"))) / F.col("w")
            late = rest.withColumn("n", F.row_number().over(Window.partitionBy("repo", "task").orderBy(race, "iid"))).where(F.col("n") <= k)
            done += [found, late.select("repo", "task", "iid", (F.col("n") + many).cast("int").alias("draw"))]
            break
        last, many = many, min(MOST_DRAWS, 4 * many)
    first = done[0]
    for x in done[1:]:
        first = first.unionByName(x)
    w = Window.partitionBy("repo", "task").orderBy("draw")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("repo", "task", "iid", "n")


def event_windows(reads: DataFrame, events: DataFrame, span: int = 10) -> DataFrame:
    """Reads within ``span`` versions after an event of their key: iid, at (event), n_reads, n_wrong, and
    whether the event changed the truth (affected). reads: iid, t, truth, served_valid."""
    before = F.lag("truth").over(Window.partitionBy("iid").orderBy("t"))
    reads = reads.withColumn("moved", before.isNotNull() & ~F.col("truth").eqNullSafe(before))
    points = events.select("iid", "at", F.explode(F.sequence(F.col("at"), F.col("at") + span - 1)).alias("t"))
    got = points.join(reads, ["iid", "t"])
    return got.groupBy("iid", "at").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if(~F.col("served_valid")).alias("n_wrong"), F.max(F.when(F.col("t") == F.col("at"), F.col("moved"))).alias("affected"))


def greedy_assignment(repos: list[tuple[str, float]], proxies: list[tuple[str, float]]) -> dict[str, str]:
    """Each repository, in the order of rising rate, gets the proxy with the nearest rate that is still
    free (ties to the first by name). Both lists are small tables of names and rates, not data."""
    free, out = dict(proxies), {}
    for name, rate in sorted(repos, key=lambda x: (x[1], x[0])):
        if not free:
            break
        best = min(sorted(free), key=lambda p: abs(math.log(rate / free[p])))
        out[name] = best
        free.pop(best)
    return out


def numbered_per(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with i, their places (from 0) within each key."""
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1)


def assigned(pairs: DataFrame, order: str = "rate") -> DataFrame:
    """Greedy one-to-one assignment from a table of pairs (repo, rate, proxy, distance): in the order of rising rate (ties
    by name) each repository gets the nearest proxy (ties by name) that is still free. Returns repo, proxy, distance.

    All repositories ask for their nearest proxy at once; a proxy keeps the one that is first in order and turns
    the others away, who ask for their next one. That ends with what taking turns gives, after as many rounds as
    proxies are fought over, without a list on the driver.
    """
    turn = F.struct(order, "repo")
    left = kept(pairs.select("repo", "rate", "proxy", "distance"))
    while True:
        asked = left.groupBy("repo").agg(F.min_by(F.struct("rate", "proxy", "distance"), F.struct("distance", "proxy")).alias("x")).select("repo", "x.*")
        held = kept(asked.withColumn("first", F.min_by("repo", turn).over(Window.partitionBy("proxy"))))
        away = held.where(F.col("repo") != F.col("first")).select("repo", "proxy")
        if away.isEmpty():
            return held.select("repo", "proxy", "distance")
        left = kept(left.join(away, ["repo", "proxy"], "left_anti"))


def proxy_windows(starts: DataFrame, commits: DataFrame, size: int) -> DataFrame:
    """For each repository (repo, start, rate) and each asset that has commits enough (asset, ct): the window of ``size``
    commits after the last one up to the start, or the last such window where there isn't one.

    repo, asset, i0 (the window's first commit, from 0), aligned, low and high (its bounds), rate (of the
    repository), distance (of the window's rate from it, as an absolute log ratio). Repositories and assets are
    short tables of names; commits are only numbered and looked up.
    """
    numbered = kept(numbered_per(commits, "asset", "ct"))
    many = numbered.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    probes = many.select("asset").crossJoin(F.broadcast(starts.select("repo", "start")))  # short tables of names
    marks = numbered.select("asset", F.col("ct").alias("at"), F.lit(None).cast("string").alias("repo"), F.lit(0).alias("probe")).unionByName(probes.select("asset", F.col("start").alias("at"), F.col("repo").cast("string").alias("repo"), F.lit(1).alias("probe")))
    before = F.count_if(F.col("probe") == 0).over(Window.partitionBy("asset").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)) - 1
    found = marks.withColumn("last", before).where("probe = 1").join(many, "asset")
    aligned = (F.col("last") >= 0) & (F.col("last") + size < F.col("n"))
    found = found.select("repo", "asset", aligned.alias("aligned"), F.when(aligned, F.col("last")).otherwise(F.col("n") - size - 1).alias("i0"))
    at = lambda name, shift: numbered.select("asset", (F.col("i") - shift).alias("i0"), F.col("ct").alias(name))
    told = found.join(at("low", 0), ["asset", "i0"]).join(at("high", size), ["asset", "i0"])
    days = F.greatest((F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col("low").cast("timestamp"))) / 86_400_000_000, F.lit(1e-9))
    told = told.join(starts.select(F.col("repo").cast("string").alias("repo"), "rate"), "repo")
    return told.withColumn("distance", F.round(F.abs(F.log(size / days / F.col("rate"))), 9))


def mapped_arrivals(chosen: DataFrame, commits: DataFrame, issues: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Issues of each repository's asset (chosen: repo, asset, i0, low, high) as its arrivals, and the clock that they are
    mapped by: arrivals (repo, time, t) and clock (repo, t, time). A clock is a window's commits, made monotone."""
    ticks = numbered_per(commits, "asset", "ct").join(chosen.select("repo", "asset", "i0"), "asset").withColumn("t", F.col("i") - F.col("i0")).where((F.col("t") >= 0) & (F.col("t") <= size))
    clock = kept(ticks.select("repo", F.col("t").cast("long").alias("t"), F.max("ct").over(Window.partitionBy("repo").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("time")))
    inside = issues.join(chosen.select("repo", "asset", "low", "high"), "asset").where((F.col("time") > F.col("low")) & (F.col("time") <= F.col("high")))
    told = asof(inside.select("repo", "time"), clock.groupBy("repo", "time").agg(F.max("t").alias("t")), "repo")  # of equal times the last
    return told.select("repo", "time", F.least(F.greatest(F.coalesce("t", F.lit(0)), F.lit(0)), F.lit(size)).cast("long").alias("t")), clock


def poisson_control(counts: DataFrame, by: str, start: str, end: str, seed: str = "poisson") -> DataFrame:
    """counts (by, n) to n arrivals between two times in seconds: order statistics of hashed uniform numbers,
    which are those of a Poisson process given its count."""
    rows = counts.select(by, F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(by).cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8)
    return rows.select(by, "i", (F.lit(float(start)) + u * F.lit(float(end) - float(start))).alias("at"))


def composed_cost(reads: DataFrame, triggers: DataFrame, derivations: DataFrame) -> DataFrame:
    """A policy put together from records: at each read (iid, t, truth) that its trigger (iid, t, fired) tells,
    the derivation that stands for it is paid. Gives per key its reads, derivations and imputed tokens."""
    fired = reads.join(triggers.where("fired").select("iid", "t"), ["iid", "t"], "left_semi")
    imputed = impute_nearest(fired.select("iid", F.col("t").alias("u"), "truth"), derivations)
    paid = imputed.groupBy("iid").agg(F.count(F.lit(1)).alias("n_derived"), F.sum("tokens").alias("tok"))
    n = reads.groupBy("iid").agg(F.count(F.lit(1)).alias("n_reads"))
    return n.join(paid, "iid", "left").select("iid", "n_reads", F.coalesce("n_derived", F.lit(0)).alias("n_derived"), F.coalesce("tok", F.lit(0)).alias("tok"))


def agreement(engine: DataFrame, recorded: DataFrame, on: list[str], value: str) -> DataFrame:
    """Share of common reads at which the engine and the record agree, and reads that only one of them has."""
    j = engine.select(*on, F.col(value).alias("x")).join(recorded.select(*on, F.col(value).alias("y")), on, "full_outer")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return j.agg(F.count_if(both).alias("n"), F.avg(F.when(both, (F.col("x") == F.col("y")).cast("int"))).alias("agree"), F.count_if(F.col("y").isNull()).alias("only_engine"), F.count_if(F.col("x").isNull()).alias("only_recorded"))


def after_commit(tasks: DataFrame, commits: DataFrame, by: str, hours: int = 24) -> DataFrame:
    """Per key: tasks, and the share that arrives within ``hours`` after a commit (both: by, time)."""
    j = asof(tasks.select(by, "time"), commits.select(by, "time", F.col("time").alias("t")), by)
    near = F.col("t").isNotNull() & (F.unix_micros(F.col("time").cast("timestamp")) - F.unix_micros(F.col("t").cast("timestamp")) <= hours * 3_600_000_000)
    return j.groupBy(by).agg(F.count(F.lit(1)).alias("n_tasks"), (F.count_if(near) / F.count(F.lit(1))).alias("within"))
