"""Facts at every snapshot as step functions: what holds from one change of the lake to the next.

A file version counts for a fact from the snapshot that puts it to the one that replaces it, so it
adds its partial aggregate once and takes it away once. Running sums over those changes give the
fact at all snapshots; no snapshot is spelled out before the end, and a version is scanned once
however many snapshots hold it. Sums and counts add up as they are (``totals``); distinct keys don't,
so each key's versions are folded to the stretches in which any of them holds it, and the stretches
are what is counted (``covered``): exact key sets that merge across versions without a rescan.

Steps are rows (by..., valid_from, valid_to, values); valid_to is null where nothing follows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Snapshots that are pruned together when the greatest counts are found.
BLOCK = 64


def periods(month: Column) -> Column:
    """The periods that a month (yyyy-MM) counts for: itself, its year and all."""
    return F.array(month, F.substring(month, 1, 4), F.lit("all"))


def dependencies(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Facts (fact, ds, period) with the file versions (ds, month, sha, valid_from, valid_to, ...) in their period,
    by an equi-join on the period: fact and the files' columns."""
    told = files.withColumn("period", F.explode(periods(F.col("month"))))
    return facts.select("fact", "ds", "period").join(told, ["ds", "period"]).select("fact", *files.columns)


def key_sets(rows: DataFrame, version: str, *columns: str) -> DataFrame:
    """The exact key set of each file version: its distinct (key, attributes...), one scan of the rows."""
    return rows.select(version, *columns).distinct()


def _changes(spans: DataFrame, keep: list[str]) -> DataFrame:
    """Each span as a row at its start (sign 1) and, where it ends, one there (sign -1)."""
    ends = F.array(F.struct(F.col("valid_from").alias("idx"), F.lit(1).alias("sign")), F.struct(F.col("valid_to").alias("idx"), F.lit(-1).alias("sign")))
    return spans.select(*keep, F.explode(ends).alias("e")).select(*keep, "e.idx", "e.sign").where("idx is not null")


def _running(deltas: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Running sums of changes (by..., idx, columns) as steps."""
    w = Window.partitionBy(*by).orderBy("idx")
    sums = [F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in columns]
    return deltas.select(*by, F.col("idx").alias("valid_from"), F.lead("idx").over(w).alias("valid_to"), *sums)


def totals(spans: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """spans (by..., sums..., valid_from, valid_to) to steps with their sums and n_files, how many spans hold."""
    rows = _changes(spans, [*by, *sums])
    deltas = rows.groupBy(*by, "idx").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in sums], F.sum("sign").alias("n_files"))
    return _running(deltas, by, [*sums, "n_files"])


def covered(members: DataFrame, by: list[str], key: str, roles: list[str], name: str = "n") -> DataFrame:
    """members (by..., key, role, valid_from, valid_to): how many keys are held by a span of every one of the
    roles, as steps. One role counts distinct keys, two the keys that two sets share."""
    rows = _changes(members, [*by, key, "role"])
    deltas = rows.groupBy(*by, key, "idx").agg(*[F.sum(F.when(F.col("role") == r, F.col("sign")).otherwise(0)).alias(f"d{i}") for i, r in enumerate(roles)])
    w = Window.partitionBy(*by, key).orderBy("idx")
    held = F.lit(True)
    for i in range(len(roles)):
        held = held & (F.sum(f"d{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)) > 0)
    now = deltas.select(*by, key, "idx", held.cast("long").alias("now"))
    turns = now.withColumn(name, F.col("now") - F.lag("now", 1, 0).over(w)).where(F.col(name) != 0)
    return _running(turns.groupBy(*by, "idx").agg(F.sum(name).alias(name)), by, [name])


def at(steps: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Steps at snapshots (idx): one row for each that they hold at, with idx in place of the two bounds."""
    rest = [c for c in steps.columns if c not in ("valid_from", "valid_to")]
    last = snapshots.agg(F.max("idx").alias("__last"))
    rows = steps.crossJoin(F.broadcast(last))  # one row
    upto = F.coalesce(F.col("valid_to") - 1, F.col("__last"))
    rows = rows.where(F.col("valid_from") <= upto).select(*rest, F.explode(F.sequence("valid_from", upto)).alias("idx"))
    return rows.join(snapshots.select("idx"), "idx", "left_semi").select("idx", *rest)


def top_at(counts: DataFrame, by: list[str], key: str, n: str, k: int, snapshots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Steps of counts per key to the k greatest at every snapshot, ties to the smaller key: by..., idx, rank, key, n.

    Snapshots go in blocks. A key whose count never reaches, within a block, what k other keys never
    fall below there can't be among the k, so it is left out before snapshots are spelled out.
    """
    last = snapshots.agg(F.max("idx").alias("__last"))
    rows = counts.where((F.col(n) > 0) & F.col(key).isNotNull()).crossJoin(F.broadcast(last))  # one row
    rows = rows.withColumn("__to", F.least(F.col("valid_to") - 1, F.col("__last"))).where(F.col("valid_from") <= F.col("__to"))
    cut = lambda c: F.floor(F.col(c) / block).cast("long")
    rows = rows.withColumn("__block", F.explode(F.sequence(cut("valid_from"), cut("__to"))))
    first, end = F.col("__block") * block, F.least((F.col("__block") + 1) * block - 1, F.col("__last"))
    rows = rows.withColumn("__from", F.greatest("valid_from", first)).withColumn("__to", F.least("__to", end)).withColumn("__all", end - first + 1)
    per = rows.groupBy(*by, "__block", key).agg(F.min(n).alias("low"), F.max(n).alias("__high"), F.sum(F.col("__to") - F.col("__from") + 1).alias("held"), F.max("__all").alias("all"))
    sure = per.where("held = all")
    w = Window.partitionBy(*by, "__block").orderBy(F.col("low").desc())
    kth = sure.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy(*by, "__block").agg(F.min("low").alias("least"), F.count(F.lit(1)).alias("sure"))
    kth = kth.where(F.col("sure") == k).drop("sure")
    open_ = per.join(kth, [*by, "__block"], "left").where(F.col("least").isNull() | (F.col("__high") >= F.col("least"))).select(*by, "__block", key)
    rows = rows.join(open_, [*by, "__block", key], "left_semi")
    spelled = rows.select(*by, key, n, F.explode(F.sequence("__from", "__to")).alias("idx")).join(snapshots.select("idx"), "idx", "left_semi")
    best = Window.partitionBy(*by, "idx").orderBy(F.col(n).desc(), F.col(key).asc())
    return spelled.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(*by, "idx", "rank", key, n)


def joined_text(top: DataFrame, by: list[str], key: str) -> DataFrame:
    """Ranked rows to one text per group and snapshot: the keys by rank, joined by commas."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", F.col(key).cast("string").alias("k"))))
    return top.groupBy(*by, "idx").agg(F.array_join(F.transform(ranked, lambda x: x["k"]), ", ").alias("answer"))


def looked_up(counts: DataFrame, lookup: DataFrame, by: list[str], key: str, name: str, n: str = "n", unmatched: str = "UNMATCHED_ID") -> DataFrame:
    """Spans of counts (by..., key, n, valid_from, valid_to) as spans by the name that a lookup (key, name, valid_from,
    valid_to), which has versions of its own, gives their key while both hold. What no version names counts as
    unmatched: all is put there, and what is matched is taken away again, so that no gap is ever computed."""
    a, b = counts.select(*by, key, n, "valid_from", "valid_to"), lookup.select(key, name, F.col("valid_from").alias("__from"), F.col("valid_to").alias("__to"))
    upto = F.least("valid_to", "__to")  # least() leaves nulls out: null only if both are open
    both = a.join(b, key).select(*by, name, n, F.greatest("valid_from", "__from").alias("valid_from"), upto.alias("valid_to")).where("valid_to is null or valid_from < valid_to")
    rest = a.unionByName(both.withColumn(n, -F.col(n)).withColumn(key, F.lit(None)).select(*a.columns))
    return both.unionByName(rest.select(*by, F.lit(unmatched).alias(name), n, "valid_from", "valid_to"))


def world_states(intervals: DataFrame) -> DataFrame:
    """The state of the whole lake as steps: an order-independent hash, the sum of a 60-bit hash of each file (path
    and content), and whether it is new (``evaluate``) or was there before. Two states are equal when the lakes are."""
    one = F.conv(F.substring(F.md5(F.concat_ws("=", "path", "sha")), 1, 15), 16, 10).cast("decimal(38,0)")
    steps = totals(intervals.select(F.lit("lake").alias("fact"), one.alias("state"), "valid_from", "valid_to"), ["fact"], ["state"]).drop("fact")
    return steps.withColumn("evaluate", F.row_number().over(Window.partitionBy("state", "n_files").orderBy("valid_from")) == 1)
