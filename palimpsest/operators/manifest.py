"""Snapshots of a changing set of files: a log of put and remove events, folded into
validity intervals, so that the files at any snapshot are a range predicate.

A change is a row (path, idx, sha), where a null sha removes the path; idx numbers the
snapshots. The fold is one window per path: no snapshot is ever spelled out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar


def number_events(events: DataFrame, lake: str, order: list[str], start_share: float = 0.4) -> DataFrame:
    """Events (time, ...) with idx, snapshot name and phase; s0 lies at a share of all snapshots.

    One row an event: the log is small beside the data, and its order is a total one.
    """
    w = Window.orderBy(*order)
    rows = events.withColumn("idx", (F.row_number().over(w) - 1).cast("long"))
    s0 = F.round(F.count(F.lit(1)).over(Window.partitionBy()) * F.lit(start_share)).cast("long")
    phase = F.when(F.col("idx") < s0, "history").when(F.col("idx") == s0, "s0").otherwise("future")
    return rows.withColumn("snapshot", F.format_string(lake + "-%04d", F.col("idx"))).withColumn("t", F.col("idx") - s0).withColumn("phase", phase)


def changes(events: DataFrame) -> DataFrame:
    """Events (idx, put map<path, sha>, remove array<path>) as changes; a put wins over a remove of its event."""
    put = events.select("idx", F.explode("put").alias("path", "sha"))
    gone = events.select("idx", F.explode("remove").alias("path")).join(put.select("idx", "path"), ["idx", "path"], "left_anti")
    return put.select("path", "idx", "sha").unionByName(gone.select("path", "idx", F.lit(None).cast("string").alias("sha")))


def fold(log: DataFrame) -> DataFrame:
    """Changes to intervals: path, sha, valid_from, valid_to (null: until now)."""
    w = Window.partitionBy("path").orderBy("idx")
    return log.withColumn("valid_to", F.lead("idx").over(w)).where("sha is not null").select("path", "sha", F.col("idx").alias("valid_from"), "valid_to")


def world(intervals: DataFrame, idx: int | Column) -> DataFrame:
    """The files of one snapshot."""
    at = F.lit(idx) if isinstance(idx, int) else idx
    return intervals.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("path", "sha")


def worlds(intervals: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The files of many snapshots (idx): each interval yields the snapshots it covers."""
    last = snapshots.agg(F.max("idx").alias("last"))
    rows = intervals.crossJoin(F.broadcast(last))  # one row
    upto = F.coalesce(F.col("valid_to") - 1, F.col("last"))
    rows = rows.where(F.col("valid_from") <= upto).select("path", "sha", F.explode(F.sequence("valid_from", upto)).alias("idx"))
    return rows.join(snapshots.select("idx"), "idx", "left_semi")


def overlay(base: DataFrame, put: DataFrame) -> DataFrame:
    """A world with some paths replaced (sha) or removed (null sha)."""
    return base.join(put.select("path"), "path", "left_anti").unionByName(put.where("sha is not null").select("path", "sha"))


def resolve_vanished(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) to the file that stands for it: the path itself, else the file with the same
    series and month, else the only file with the same basename, else none."""
    month = lambda p: F.regexp_extract(p, r"(\d{4}-\d{2})", 1)
    f = files.select(F.col("path").alias("found"))
    alike = lambda x, p: (scalar.series_pattern(scalar.basename(F.col(p))).alias(f"{x}s"), month(F.col(p)).alias(f"{x}m"))
    by_month = f.select("found", *alike("f", "found")).groupBy("fs", "fm").agg(F.min("found").alias("by_month"))
    by_name = f.groupBy(scalar.basename(F.col("found")).alias("fb")).agg(F.min("found").alias("one"), F.count(F.lit(1)).alias("n")).where("n = 1").select("fb", F.col("one").alias("by_name"))
    out = wanted.join(f, wanted["path"] == f["found"], "left").select("path", "found", *alike("w", "path"), scalar.basename(F.col("path")).alias("wb"))
    out = out.join(by_month, (F.col("ws") == F.col("fs")) & (F.col("wm") == F.col("fm")) & (F.col("wm") != ""), "left")
    out = out.join(by_name, F.col("wb") == F.col("fb"), "left")
    return out.select("path", F.coalesce("found", "by_month", "by_name").alias("resolved"))


def series_members(files: DataFrame) -> DataFrame:
    """Each file's series and its rank in it, newest first: by four-digit numbers, other numbers, path."""
    numbers = F.regexp_extract_all("path", F.lit(r"(\d+)"))
    years = F.filter(numbers, lambda x: F.length(x) == 4)
    rest = F.transform(F.filter(numbers, lambda x: F.length(x) != 4), lambda x: x.cast("decimal(38,0)"))
    rows = files.select("path", scalar.series_pattern(F.col("path")).alias("series"), years.alias("y"), rest.alias("r"))
    w = Window.partitionBy("series").orderBy(F.col("y").desc(), F.col("r").desc(), F.col("path").desc())
    return rows.select("series", "path", F.row_number().over(w).alias("rank"))


def change_counts(log: DataFrame) -> DataFrame:
    """How often each path's content changed."""
    before = F.lag("sha").over(Window.partitionBy("path").orderBy("idx"))
    return log.withColumn("before", before).groupBy("path").agg(F.count_if(~F.col("sha").eqNullSafe(F.col("before"))).alias("n_changes"))


def schema_changes(columns: DataFrame, at: str) -> DataFrame:
    """columns (at, name, type) of a series of files: where the columns differ from the file before, the
    names added, removed and retyped, each sorted and joined by commas."""
    held = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "type"))))
    one = columns.groupBy(at).agg(held.alias("now")).withColumn("before", F.lag("now").over(Window.orderBy(at)))  # one row a file
    names = lambda a, b: F.array_sort(F.array_except(F.map_keys(a), F.map_keys(b)))
    both = F.array_sort(F.filter(F.array_intersect(F.map_keys("now"), F.map_keys("before")), lambda k: ~F.element_at("now", k).eqNullSafe(F.element_at("before", k))))
    out = one.where("before is not null").select(at, names("now", "before").alias("added"), names("before", "now").alias("removed"), both.alias("retyped"))
    return out.where("size(added) + size(removed) + size(retyped) > 0").select(at, *[F.array_join(c, ",").alias(c) for c in ("added", "removed", "retyped")])


def split_parts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each partition's rows in two part files: the first half and the rest."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(*order)) - 1
    return rows.withColumn("part", F.when(place < F.floor(F.count(F.lit(1)).over(w) / 2), 0).otherwise(1))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Bag equality of two tables."""
    return a.exceptAll(b).limit(1).count() == 0 and b.exceptAll(a).limit(1).count() == 0


def partition_index(files: DataFrame, pattern: str) -> DataFrame:
    """Partition files by dataset and month: ds, month, paths (sorted). The pattern's groups are ds and month."""
    part = lambda i: F.regexp_extract("path", pattern, i)
    return files.where(F.col("path").rlike(pattern)).groupBy(part(1).alias("ds"), part(2).alias("month")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def period_parts(index: DataFrame, ds: str, period: str) -> DataFrame:
    """Files of a dataset in a period (yyyy-MM, yyyy or all), chosen before anything is scanned."""
    rows = index.where(F.col("ds") == ds)
    rows = rows if period == "all" else rows.where(F.col("month").startswith(period))
    return rows.select("ds", "month", F.explode("paths").alias("path"))


def latest_parts(index: DataFrame) -> DataFrame:
    """Per dataset, the files of its last month."""
    return index.groupBy("ds").agg(F.max("month").alias("month"), F.max_by("paths", "month").alias("paths"))


def relevant(facts: DataFrame, files: DataFrame) -> DataFrame:
    """The exact dependency set of each fact: facts (fact, ds, period) with the files (ds, month, ...) in their period."""
    inside = (F.col("period") == "all") | F.col("month").startswith(F.col("period"))
    return facts.join(files, "ds").where(inside)


def rename(base: DataFrame, old: str, new: str, idx: int) -> DataFrame:
    """The changes of a snapshot that moves a folder: each file is removed and put under its new path."""
    moved = base.where(F.col("path").startswith(old))
    to = F.concat(F.lit(new), F.substring("path", len(old) + 1, 1 << 20))
    gone = moved.select("path", F.lit(idx).cast("long").alias("idx"), F.lit(None).cast("string").alias("sha"))
    return moved.select(to.alias("path"), F.lit(idx).cast("long").alias("idx"), "sha").unionByName(gone)


def bootstrap_versions(docs: DataFrame, start) -> DataFrame:
    """docs (path, arrival, sha): the version that the first snapshot holds, the latest up to the start, else the earliest."""
    there = F.when(F.col("arrival") <= start, F.col("arrival"))
    chosen = F.coalesce(F.max(there), F.min("arrival"))
    sha = F.coalesce(F.max_by("sha", there), F.min_by("sha", "arrival"))
    return docs.groupBy("path").agg(chosen.alias("arrival"), sha.alias("sha"))


def real_only(log: DataFrame) -> DataFrame:
    """A log (path, idx, sha, synthetic) without its synthetic events: earlier puts of a path get the last
    synthetic content, which a later synthetic removal has none of, and numbers stay as they are."""
    put = F.when(F.col("sha").isNotNull(), F.col("idx"))
    final = log.where("synthetic").groupBy("path").agg(F.max_by("sha", put).alias("final"), F.max("idx").alias("upto"))
    rows = log.where("not synthetic").join(final, "path", "left")
    sha = F.when((F.col("idx") < F.col("upto")) & F.col("sha").isNotNull(), F.col("final")).otherwise(F.col("sha"))
    return rows.select("path", "idx", sha.alias("sha"))


def two_versions(intervals: DataFrame, a: int, b: int) -> DataFrame:
    """The files of two snapshots side by side: path, old, new (null where it isn't there)."""
    x = world(intervals, a).withColumnRenamed("sha", "old")
    return x.join(world(intervals, b).withColumnRenamed("sha", "new"), "path", "full_outer").select("path", "old", "new")


def release_date(month, lag: int, day: int):
    """When the data of a month (text yyyy-MM) come out: a day of the month ``lag`` months later."""
    return F.date_add(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), lag), day - 1)


def newest(files: DataFrame) -> DataFrame:
    """Each series of files (idx, path) at each snapshot: its newest member and how many it has. idx, series, path, n_members."""
    years = F.filter(F.regexp_extract_all("path", F.lit(r"(\d+)")), lambda x: F.length(x) == 4)
    rest = F.transform(F.filter(F.regexp_extract_all("path", F.lit(r"(\d+)")), lambda x: F.length(x) != 4), lambda x: x.cast("decimal(38,0)"))
    return files.groupBy("idx", scalar.series_pattern(F.col("path")).alias("series")).agg(F.max_by("path", F.struct(years, rest, "path")).alias("path"), F.count(F.lit(1)).alias("n_members"))


def named_series(path, question):
    """The series of a path that a question is about: runs of digits become # but for a year, or a year and month,
    that the question names."""
    month, year = F.regexp_extract(path, r"(\d{4}-\d{2})", 1), F.regexp_extract(path, r"(\d{4})", 1)
    held = lambda x: (x != "") & F.contains(question, x)
    loose = lambda p: F.regexp_replace(p, r"\d+", "#")
    keep = lambda p, part, f: F.call_function("array_join", F.transform(F.split(p, part), f), part)
    by_year = keep(path, year, loose)
    whole = keep(path, month, lambda p: keep(p, year, loose))
    return F.when(held(month), whole).when(held(year), by_year).otherwise(loose(path))
