"""Per-partition profiles and the fact families answered from them.

A profile is the partial aggregate of one file version: counts, exact sums, data-quality
counts, extremes. A fact at a snapshot combines the profiles of the files that it depends
on, so a version is scanned once however many snapshots hold it. Keyed counts (zones,
models) stay a long table beside the profile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import manifest
from palimpsest.sources.working import kept


def profile(rows: DataFrame, key: str, ts: str, numbers: list[str]) -> DataFrame:
    """One row per file version: n, extremes of ts, rows outside their month, and per number
    column its non-null count, exact sum, negatives and zeros. One scan, one shuffle of partial sums."""
    aggs = [F.count(F.lit(1)).alias("n"), F.min(ts).alias("min_ts"), F.max(ts).alias("max_ts"), F.count_if(scalar.outside_month(F.col(ts), F.col(key))).alias("n_outside")]
    for c in numbers:
        x = F.col(c)
        aggs += [F.count(x).alias(f"nn_{c}"), F.sum(scalar.exact_cents(x)).alias(f"sum_{c}"), F.count_if(x < 0).alias(f"neg_{c}"), F.count_if(x == 0).alias(f"zero_{c}")]
    return rows.groupBy(key).agg(*aggs)


def keyed_counts(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Rows per file version and value."""
    return rows.groupBy(key, by).agg(F.count(F.lit(1)).alias("n"))


def running(profiles: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Every snapshot's running total, where snapshot i holds the partitions up to i: a window over
    one row per partition."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return profiles.select(key, *[F.sum(c).over(w).alias(name) for name, c in sums.items()])


def combine(manifest: DataFrame, profiles: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Facts at snapshots (idx, sha) from profiles by sha: sums of partial aggregates."""
    return manifest.join(profiles, "sha").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def mean(total: str, count: str, places: int = 4):
    """Exact mean, ties to even, over the non-null values."""
    return scalar.ratio_half_even(F.col(total), F.col(count), places, scale=2)


def top(counts: DataFrame, by: list[str], key: str, n: str, k: int, joiner: str = ", ") -> DataFrame:
    """The k greatest counts of each group, ties to the smaller key, as rows (rank) — null never wins."""
    w = Window.partitionBy(*by).orderBy(F.col(n).desc(), F.col(key).asc())
    return counts.where(F.col(key).isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_text(counts: DataFrame, by: list[str], key: str, n: str, k: int) -> DataFrame:
    """The same as one text per group; NONE for an empty one."""
    rows = top(counts, by, key, n, k)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k")))), lambda x: x["k"]), ", ")
    return rows.groupBy(*by).agg(scalar.answer(joined).alias("answer"))


def lookup_counts(counts: DataFrame, key: str, lookup: DataFrame, lookup_key: str, name: str, unmatched: str = "UNMATCHED_ID") -> DataFrame:
    """Counts by a looked-up name: keys are counted first, so the join sees one row per key."""
    j = counts.join(F.broadcast(lookup.select(F.col(lookup_key).alias("__k"), name)), F.col(key) == F.col("__k"), "left") if lookup.limit(100_001).count() <= 100_000 else counts.join(lookup.select(F.col(lookup_key).alias("__k"), name), F.col(key) == F.col("__k"), "left")
    return j.groupBy(F.coalesce(name, F.lit(unmatched)).alias(name)).agg(F.sum("n").alias("n"))


def cohort_failed(rows: DataFrame, serial: str, in_cohort, failed) -> DataFrame:
    """How many members of a cohort failed at any time: semi joins of distinct keys."""
    members = rows.where(in_cohort).select(serial).distinct()
    return members.join(rows.where(failed).select(serial), serial, "left_semi").agg(F.count(F.lit(1)).alias("n"))


def coverage(columns: DataFrame, column: str) -> DataFrame:
    """columns (ds, month, name): per dataset the first and last month, and the months, that have a column (exact case)."""
    has = F.col("name") == column
    per = columns.groupBy("ds", "month").agg(F.max(has).alias("has"))
    return per.groupBy("ds").agg(F.min(F.when(F.col("has"), F.col("month"))).alias("first_month"), F.max(F.when(F.col("has"), F.col("month"))).alias("latest_month"), F.count_if("has").alias("n_months"))


def concept(columns: DataFrame, candidates: list[str]) -> DataFrame:
    """columns (ds, name): per dataset the exact spelling of the first candidate that exists, in any case."""
    order = F.array_position(F.array(*[F.lit(c.lower()) for c in candidates]), F.lower("name"))
    return columns.where(order > 0).groupBy("ds").agg(F.min_by("name", F.struct(order, "name")).alias("column"))


def fact_series(facts: DataFrame, worlds: DataFrame, profiles: DataFrame, sums: list[str]) -> DataFrame:
    """Facts (fact, ds, period) at every snapshot, through their exact dependency sets.

    worlds: idx, path, sha, ds, month; profiles: one row per file version (sha). Each version was
    scanned once, however many snapshots hold it. Gives fact, idx, the sums, the dependency key and
    whether it is new in the fact's series (evaluate) or seen before.
    """
    deps = manifest.relevant(facts, worlds).join(profiles, "sha")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat_ws("=", x["path"], x["sha"]))
    rows = deps.groupBy("fact", "idx").agg(*[F.sum(c).alias(c) for c in sums], scalar.fingerprint(parts).alias("dep"))
    first = F.row_number().over(Window.partitionBy("fact", "dep").orderBy("idx")) == 1
    return rows.withColumn("evaluate", first)


def base_rates(series: DataFrame, value: str) -> DataFrame:
    """Per group of facts (type, fact, idx, value): facts, the share whose value ever changes, and how many values they take."""
    per = series.groupBy("type", "fact").agg(F.countDistinct(value).alias("n"))
    return per.groupBy("type").agg(F.count(F.lit(1)).alias("n_facts"), (F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("changing"), F.avg("n").alias("mean_values"))


def entity_profile(rows: DataFrame, by: str, serial: str, model: str, failed, capacity: str) -> DataFrame:
    """Per file version of an entity table: rows, failures, entities, models, and the capacity's count, negatives and exact sum."""
    c = F.col(capacity)
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(failed).alias("failures"),
        F.countDistinct(serial).alias("n_serials"),
        F.countDistinct(model).alias("n_models"),
        F.count(c).alias("n_capacity"),
        F.count_if(c < 0).alias("neg_capacity"),
        F.sum(scalar.exact_cents(c)).alias("sum_capacity"),
    )


def quality_fraction(rows: DataFrame, by: str, check: str, column: str, places: int = 5) -> DataFrame:
    """Share of rows that fail a check (null, neg or zero), as text with ties to even; NONE without rows.
    Of a column that isn't there, all rows are null and none is negative or zero."""
    if column in rows.columns:
        x = F.col(column)
        bad = {"null": x.isNull(), "neg": x < 0, "zero": x == 0}[check]
    else:
        bad = F.lit(check == "null")
    g = rows.groupBy(by).agg(F.count_if(bad).alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select(by, scalar.answer(scalar.ratio_half_even(F.col("a"), F.col("b"), places)).alias("answer"))


def quota_sample(candidates: DataFrame, seed: str, pool: int = 150, natural: int = 11, enriched: int = 11, extra: int = 600) -> DataFrame:
    """Facts of each type drawn by quota: type, fact, kind (natural, enriched or fill). candidates: type, fact, valid (it has
    a value), changing (the value changes later).

    Candidates are scanned in the order of a keyed hash until ``pool`` valid ones are found; ``natural`` of them are
    drawn as they are. ``enriched`` more are drawn from those that change: the rest of the pool's, and, where these
    are few, the changing ones of up to ``extra`` further candidates, until three times the quota. What is still
    missing is filled from the pool. All draws are least hashes, so each is a bounded rank per type, of which tasks
    send only their own best; nothing depends on how the rows are laid out.
    """
    h = lambda use: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit(use), "type", F.col("fact").cast("string"))), 1, 15), 16, 10).cast("long")
    first = lambda rows, order, n: rows.withColumn("__r", F.row_number().over(Window.partitionBy("type").orderBy(order, "fact"))).where(F.col("__r") <= n)
    rows = candidates.select("type", "fact", "valid", "changing").withColumn("scan", h("scan"))
    picked = kept(first(rows.where("valid"), "scan", pool).drop("__r", "valid"))
    drawn = kept(first(picked.withColumn("draw", h("natural")), "draw", natural).select("type", "fact", F.lit("natural").alias("kind")))
    rest = picked.join(drawn.select("type", "fact"), ["type", "fact"], "left_anti")
    changing = rest.where("changing").select("type", "fact")
    # beyond the pool: only where it was filled, from its last candidate on
    ends = picked.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("scan", "fact")).alias("end")).where(F.col("n") == pool).select("type", "end")
    short = ends.join(changing.groupBy("type").agg(F.count(F.lit(1)).alias("have")), "type", "left").withColumn("want", 3 * enriched - F.coalesce("have", F.lit(0))).where("want > 0")
    beyond = first(rows.join(short.drop("have"), "type").where(F.struct("scan", "fact") > F.col("end")), "scan", extra).where("valid and changing").drop("__r")
    more = first(beyond, "scan", 3 * enriched).where(F.col("__r") <= F.col("want")).select("type", "fact")
    rich = kept(first(changing.unionByName(more).withColumn("draw", h("enriched")), "draw", enriched).select("type", "fact", F.lit("enriched").alias("kind")))
    missing = picked.select("type").distinct().join(rich.groupBy("type").agg(F.count(F.lit(1)).alias("have")), "type", "left").withColumn("want", F.lit(enriched) - F.coalesce("have", F.lit(0)))
    left = rest.join(rich.select("type", "fact"), ["type", "fact"], "left_anti").withColumn("draw", h("fill"))
    fill = first(left, "draw", enriched).join(missing, "type").where(F.col("__r") <= F.col("want")).select("type", "fact", F.lit("fill").alias("kind"))
    return drawn.unionByName(rich).unionByName(fill)
