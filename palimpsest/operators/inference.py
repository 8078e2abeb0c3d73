"""Statistics over per-key rows: resampled intervals, paired differences, weights, ranks.

Resampling weights come from hashes (a Poisson bootstrap), so that replicates need no shared
generator, agree on every run, and are one aggregate over (replicate, key).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def poisson_weight(key: Column, replicate: Column, seed: str = "boot") -> Column:
    """A Poisson(1) weight from the hash of key and replicate, by its distribution function."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / float(16**8)
    w, total = F.lit(8), 0.0
    steps = []
    for k in range(8):
        total += math.exp(-1.0) / math.factorial(k)
        steps.append((k, total))
    for k, upto in reversed(steps):
        w = F.when(u < upto, F.lit(k)).otherwise(w)
    return w


def bootstrap_ratio(facts: DataFrame, key: str, num: str, den: str, replicates: int = 200, by: str | None = None) -> DataFrame:
    """Ratio of sums with the 2.5 and 97.5 percentiles of its replicates; ``by`` draws whole clusters."""
    unit = by or key
    per = facts.groupBy(unit).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    rep = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.col(unit), F.col("r"))
    one = rep.groupBy("r").agg((F.sum(w * F.col("a")) / F.greatest(F.sum(w * F.col("b")), F.lit(1))).alias("x"))
    point = per.agg((F.sum("a") / F.greatest(F.sum("b"), F.lit(1))).alias("ratio"))
    band = one.agg(F.expr("percentile(x, 0.025)").alias("low"), F.expr("percentile(x, 0.975)").alias("high"))
    return point.crossJoin(F.broadcast(band))  # one row each


def leave_one_out(facts: DataFrame, group: str, num: str, den: str) -> DataFrame:
    """The ratio of sums without each group: the total less the group."""
    per = facts.groupBy(group).agg(F.sum(num).alias("a"), F.sum(den).alias("b"))
    w = Window.partitionBy()
    return per.select(group, ((F.sum("a").over(w) - F.col("a")) / F.greatest(F.sum("b").over(w) - F.col("b"), F.lit(1))).alias("ratio"))


def paired(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Differences a - b over common keys: n, mean, wins, losses, ties and the sign test's two-sided p."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    d = F.col("x") - F.col("y")
    out = j.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_diff"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    return out


def sign_test(wins: int, losses: int) -> float:
    """Two-sided exact binomial tail."""
    n = wins + losses
    if n == 0:
        return 1.0
    tail = sum(math.comb(n, k) for k in range(min(wins, losses) + 1)) / 2**n
    return min(1.0, 2 * tail)


def non_inferior(high: float, margin: float) -> bool:
    """Whether the upper bound of a difference stays below the margin."""
    return high < margin


def post_stratified(sample: DataFrame, population: DataFrame, stratum: str, value: str) -> DataFrame:
    """Weighted mean with weights population share / sample share, and the effective sample size."""
    n, m = F.count(F.lit(1)), Window.partitionBy()
    s = sample.groupBy(stratum).agg(n.alias("ns"), F.sum(value).alias("v"))
    s = s.withColumn("ps", F.col("ns") / F.sum("ns").over(m))
    p = population.groupBy(stratum).agg(n.alias("np"))
    p = p.withColumn("pp", F.col("np") / F.sum("np").over(m))
    j = s.join(p, stratum).withColumn("w", F.col("pp") / F.col("ps"))
    return j.agg((F.sum(F.col("w") * F.col("v")) / F.sum(F.col("w") * F.col("ns"))).alias("mean"), (F.pow(F.sum(F.col("w") * F.col("ns")), 2) / F.sum(F.col("w") * F.col("w") * F.col("ns"))).alias("effective_n"))


def kendall(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Kendall's tau between two scores of the same keys; a table of policies, so pairs are few."""
    a = points.select(F.col(key).alias("k1"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    b = points.select(F.col(key).alias("k2"), F.col(x).alias("x2"), F.col(y).alias("y2"))
    pairs = a.join(b, F.col("k1") < F.col("k2"))
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    return pairs.agg((F.sum(s) / F.count(F.lit(1))).alias("tau"), F.count(F.lit(1)).alias("pairs"))


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile({value}, {p})").alias(f"p{round(p * 100)}") for p in at])


def pair_persistence(derivations: DataFrame) -> DataFrame:
    """All pairs of a key's derivations (iid, answer, valid): both wrong, same answer. Pairs are counted
    from the sizes of their groups: n rows make n (n - 1) / 2."""
    pairs = lambda n: F.col(n) * (F.col(n) - 1) / 2
    per = derivations.groupBy("iid", "answer").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("valid")).alias("w"))
    key = per.groupBy("iid").agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum(pairs("w")).alias("same"))
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return key.agg(whole(pairs("n")).alias("pairs"), whole(pairs("w")).alias("both_wrong"), whole(F.col("same")).alias("same_wrong"))


def bootstrap_mean(rows: DataFrame, key: str, value: str, replicates: int = 1000, seed: str = "boot", levels: tuple[float, ...] = (0.95, 0.9)) -> DataFrame:
    """Mean of one value a key (or cluster), with percentile intervals of hash-weighted replicates at each level."""
    per = rows.groupBy(F.col(key).alias("k")).agg(F.sum(value).alias("a"), F.count(F.lit(1)).alias("b"))
    rep = per.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.col("k"), F.col("r"), seed)
    one = rep.groupBy("r").agg((F.sum(w * F.col("a")) / F.greatest(F.sum(w * F.col("b")), F.lit(1))).alias("x"))
    bands = [F.expr(f"percentile(x, {q})").alias(f"{side}{round(level * 100)}") for level in levels for side, q in (("low", round((1 - level) / 2, 6)), ("high", round((1 + level) / 2, 6)))]
    point = per.agg((F.sum("a") / F.greatest(F.sum("b"), F.lit(1))).alias("mean"))
    return point.crossJoin(F.broadcast(one.agg(*bands)))  # one row each


def bootstrap_quotient(facts: DataFrame, key: str, num: str, den: str, replicates: int = 1000) -> DataFrame:
    """mean(num) / mean(den) over the same keys with its 95 % interval."""
    return bootstrap_ratio(facts, key, num, den, replicates)


def differences(a: DataFrame, b: DataFrame, key: str, value: str, cluster=None) -> DataFrame:
    """key, d: a - b over common keys, and the cluster of each key."""
    j = a.select(key, F.col(value).alias("x")).join(b.select(key, F.col(value).alias("y")), key)
    rows = j.select(key, (F.col("x") - F.col("y")).alias("d"))
    return rows if cluster is None else rows.withColumn("cluster", cluster)


def wilcoxon(rows: DataFrame, d: str = "d") -> DataFrame:
    """Signed-rank sums of the differences that aren't 0, with mean ranks for ties, and their normal score.

    Ranks come from the counts of each absolute difference, so that rows are counted, not sorted.
    """
    c = rows.where(F.col(d) != 0).groupBy(F.abs(d).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(d) > 0).alias("up"))
    before = F.sum("n").over(Window.orderBy("x")) - F.col("n")  # one row a distinct difference
    r = c.withColumn("rank", before + (F.col("n") + 1) / 2)
    s = r.agg(F.sum("n").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus"), F.sum(F.col("n") * F.col("n") * F.col("n") - F.col("n")).alias("ties"))
    n = F.col("n")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("n", "w_plus", "w_minus", ((F.col("w_plus") - n * (n + 1) / 4) / sd).alias("z"))


def margins(interval: DataFrame, at: list[float]) -> DataFrame:
    """interval (low90, high90) of a difference at each margin: not inferior (its upper bound stays below the
    margin) and equivalent (both bounds stay within it: two one-sided tests at 5 %)."""
    m = F.explode(F.array(*map(F.lit, at)))
    rows = interval.select("low90", "high90", m.alias("margin"))
    low, high, m = F.col("low90"), F.col("high90"), F.col("margin")
    return rows.select("margin", (high < m).alias("non_inferior"), ((high < m) & (low > -m)).alias("equivalent"))


def stratified_bootstrap(sample: DataFrame, population: DataFrame, stratum: str, key: str, value: str, replicates: int = 1000) -> DataFrame:
    """Post-stratified mean with a 95 % interval: keys are drawn within strata, whose shares are the population's."""
    p = population.groupBy(stratum).agg(F.count(F.lit(1)).alias("np"))
    p = p.select(stratum, (F.col("np") / F.sum("np").over(Window.partitionBy())).alias("share"))  # one row a stratum
    rep = sample.select(stratum, key, value).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    w = F.when(F.col("r") == 0, 1).otherwise(poisson_weight(F.col(key), F.col("r"), "strata"))
    per = rep.groupBy("r", stratum).agg((F.sum(w * F.col(value)) / F.greatest(F.sum(w), F.lit(1))).alias("m"))
    one = per.join(F.broadcast(p), stratum).groupBy("r").agg((F.sum(F.col("share") * F.col("m")) / F.sum("share")).alias("x"))
    x = F.when(F.col("r") > 0, F.col("x"))
    q = lambda at: F.percentile(x, F.lit(at))
    return one.agg(F.max(F.when(F.col("r") == 0, F.col("x"))).alias("mean"), q(0.025).alias("low"), q(0.975).alias("high"))


def break_even(points: DataFrame, key: str, tok: str, tools: str, baseline) -> DataFrame:
    """At which weight of a tool call, in tokens, each policy costs what the baseline does: the quotient of the
    differences; always or never cheaper where both have one sign."""
    w = Window.partitionBy()  # one row a policy
    base = lambda c: F.max(F.when(F.col(key) == baseline, F.col(c))).over(w)
    rows = points.withColumn("dt", F.col(tok) - base(tok)).withColumn("dc", base(tools) - F.col(tools)).where(F.col(key) != baseline)
    dt, dc = F.col("dt"), F.col("dc")
    case = F.when((dt <= 0) & (dc >= 0), "always").when((dt >= 0) & (dc <= 0), "never").when(dc > 0, "above").otherwise("below")
    return rows.select(key, case.alias("cheaper"), F.when(case.isin("above", "below"), dt / dc).alias("weight"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each stratum: those with the least hash of seed and key. Candidates are cut to k a part first,
    by a top-k that Spark pushes below the shuffle."""
    w = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), key)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """A short table of distinct values (months, snapshots) with their places from 0."""
    return rows.withColumn(name, (F.row_number().over(Window.orderBy(order)) - 1).cast("long"))
