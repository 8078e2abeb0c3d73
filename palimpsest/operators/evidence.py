"""Evidence behind stored answers: fingerprints of what a query depends on, so that it is
evaluated once per distinct state, and re-evaluated only when that state changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import groups


def dependency_key(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (by..., path, sha): one hash over the sorted dependencies of each group."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("path", "sha"))), lambda x: F.concat_ws("=", x["path"], x["sha"]))
    return rows.groupBy(*by).agg(scalar.fingerprint(parts).alias("dep"))


def memo(keys: DataFrame, by: list[str], order: str) -> DataFrame:
    """For each state, whether it is its first occurrence in the series (evaluate) or a later one (memo)."""
    w = Window.partitionBy(*by, "dep").orderBy(order)
    return keys.withColumn("evaluate", F.row_number().over(w) == 1)


def change_points(states: DataFrame, by: list[str], order: str, state: str = "state") -> DataFrame:
    """Rows whose state differs from the row before: where a guard fires. The first row doesn't."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(order))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(order)) == 1
    return states.withColumn("changed", ~first & ~F.col(state).eqNullSafe(before))


def state_counts(states: DataFrame, by: list[str], order: str, truth: str, state: str = "state") -> DataFrame:
    """Distinct states, changes, and incomplete reads (the truth changed while the state stayed)."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = states.withColumn("s0", F.lag(state).over(w)).withColumn("v0", F.lag(truth).over(w)).withColumn("i", F.row_number().over(w))
    moved = (F.col("i") > 1) & ~F.col(truth).eqNullSafe(F.col("v0"))
    return rows.groupBy(*by).agg(
        F.countDistinct(state).alias("n_states"),
        F.count_if((F.col("i") > 1) & ~F.col(state).eqNullSafe(F.col("s0"))).alias("n_changes"),
        F.count_if(moved & F.col(state).eqNullSafe(F.col("s0"))).alias("n_incomplete"),
    )


def line_delta(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Sets of lines that two texts gained and lost."""
    a, b = F.array_distinct(F.split(old, "\n")), F.array_distinct(F.split(new, "\n"))
    return pairs.withColumn("added", F.sort_array(F.array_except(b, a))).withColumn("removed", F.sort_array(F.array_except(a, b)))


def citations(texts: DataFrame, cites: DataFrame, least: int = 8) -> DataFrame:
    """texts (iid, t, text) and cites (iid, cite): which cited lines stand in each text: iid, t, present.
    A line hits when it equals the cite, or contains it and the cite has ``least`` characters."""
    rows = texts.join(cites, "iid")
    lines = F.split("text", "\n")
    hit = F.exists(lines, lambda x: (F.trim(x) == F.trim(F.col("cite"))) | ((F.length("cite") >= least) & F.contains(x, F.col("cite"))))
    return rows.select("iid", "t", "cite", hit.alias("hit")).groupBy("iid", "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("cite", "hit"))), lambda x: x["hit"]).alias("present"))


def spans(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """Relocate content-anchored spans: anchors (path, first, last, at) to the unique lines nearest to
    where they were. Returns path, start_line, end_line (null if an anchor line is gone)."""
    from palimpsest.operators.observe import text_lines

    lines = text_lines(texts)
    j = lines.join(anchors, "path")
    near = lambda c: F.min_by(F.when(F.col("line") == F.col(c), F.col("line_no")), F.when(F.col("line") == F.col(c), F.abs(F.col("line_no") - F.col("at"))))
    return j.groupBy("path", "first", "last", "at").agg(near("first").alias("start_line"), near("last").alias("end_line")).select("path", "start_line", "end_line")


def verdicts(states: DataFrame, table: DataFrame, on: list[str], default: str = "unsure") -> DataFrame:
    """States with their recorded verdicts; a miss is ``unsure``."""
    return states.join(table, on, "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def combine_samples(samples: DataFrame, by: list[str], rule: str = "majority") -> DataFrame:
    """Several sampled verdicts to one: unanimous or majority; without one, unsure."""
    counts = samples.groupBy(*by, "verdict").agg(F.count(F.lit(1)).alias("n"))
    total = counts.withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    wins = F.col("n") == F.col("all") if rule == "unanimous" else F.col("n") * 2 > F.col("all")
    return total.groupBy(*by).agg(F.coalesce(F.max(F.when(wins, F.col("verdict"))), F.lit("unsure")).alias("verdict"))


def span_anchors(texts: DataFrame, least: int = 6) -> DataFrame:
    """Per text (path, text), its first and last distinctive line: of ``least`` characters and unlike any other line."""
    from palimpsest.operators.observe import text_lines

    one = text_lines(texts).where(F.length("line") >= least).groupBy("path", "line").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n")).where("n = 1")
    return one.groupBy("path").agg(F.min_by("line", "line_no").alias("first"), F.max_by("line", "line_no").alias("last"))


def auto_citations(texts: DataFrame, items: DataFrame, most: int = 8) -> DataFrame:
    """The first lines of each text (path, text) that hold an item of its answer (path, item): path, line_no, line."""
    from palimpsest.operators.observe import text_lines

    hit = text_lines(texts).join(items, "path").where(F.contains("line", F.col("item"))).select("path", "line_no", "line").distinct()
    w = Window.partitionBy("path").orderBy("line_no")
    return hit.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")


def decode(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """rows (iid, value_hash, ...) with the values that a dictionary (iid, value_hash, value) tells."""
    return rows.join(dictionary, ["iid", "value_hash"])


def capped_groups(items: DataFrame, by: str, order: str, size: str, most: int) -> DataFrame:
    """Items of a key in order, put into groups of at most ``most`` in size (a larger item is a group of its own):
    by, group, n_items, total. No row and no task holds a key."""
    told = groups.grouped(items.select(by, order, size), by, [order], size, most)
    return told.groupBy(by, "group").agg(F.count(F.lit(1)).alias("n_items"), F.sum(F.col(size).cast("long")).alias("total"))


def hunks(pairs: DataFrame, old: str, new: str, context: int = 2) -> DataFrame:
    """pairs with hunks: of the unified difference of two texts with some lines of context, each hunk's first
    line in the new text, its number of lines there, and its text. Text differences are no column expression."""

    @F.pandas_udf("array<struct<start:int,lines:int,text:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        def one(x, y):
            x, y = (x or "").split("\n"), (y or "").split("\n")
            out = []
            for group in difflib.SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context):
                lines = []
                for tag, i1, i2, j1, j2 in group:
                    if tag == "equal":
                        lines += [" " + z for z in x[i1:i2]]
                    else:
                        lines += ["-" + z for z in x[i1:i2]] + ["+" + z for z in y[j1:j2]]
                out.append({"start": group[0][3] + 1, "lines": group[-1][4] - group[0][3], "text": "\n".join(lines)})
            return out

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return pairs.withColumn("hunks", diff(F.col(old), F.col(new)))


def hunk_rows(pairs: DataFrame, keys: list[str], old: str, new: str, context: int = 2) -> DataFrame:
    """The hunks of pairs of texts as rows: keys, hunk (from 0), start and lines (in the old text, from 0), text."""

    @F.pandas_udf("array<struct<start:long,lines:long,text:string>>")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        def one(x, y):
            x, y = (x or "").split("\n"), (y or "").split("\n")
            out = []
            for found in difflib.SequenceMatcher(None, x, y, autojunk=False).get_grouped_opcodes(context):
                lines = []
                for tag, i1, i2, j1, j2 in found:
                    lines += [" " + z for z in x[i1:i2]] if tag == "equal" else ["-" + z for z in x[i1:i2]] + ["+" + z for z in y[j1:j2]]
                out.append({"start": found[0][1], "lines": found[-1][2] - found[0][1], "text": "\n".join(lines)})
            return out

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    told = pairs.select(*keys, F.posexplode(diff(F.col(old), F.col(new))).alias("hunk", "h"))
    return told.select(*keys, "hunk", "h.start", "h.lines", "h.text")


def citation_hits(texts: DataFrame, cites: DataFrame, keys: list[str], text: str, least: int = 8) -> DataFrame:
    """Lines of texts (keys, text) that cites (keys, cite) hit: keys, line (from 0). A line hits when it equals a cite but for
    blanks around it, or contains one of ``least`` characters or more."""
    lines = texts.join(cites.groupBy(*keys).agg(F.collect_set("cite").alias("__cites")), keys).select(*keys, "__cites", F.posexplode(F.split(text, "\n")).alias("line", "__l"))
    hit = F.exists("__cites", lambda c: (F.trim("__l") == c) | ((F.length(c) >= least) & F.contains("__l", c)))
    return lines.where(hit).select(*keys, F.col("line").cast("long").alias("line"))


def nearest_hits(hunks: DataFrame, hits: DataFrame, keys: list[str], none: int = 10**6) -> DataFrame:
    """hunks (keys, hunk, start, lines) with distance: from the hunk's stretch of lines to the nearest hit (keys, line), 0 inside
    it; ``none`` plus the hunk's number where its text has no hit. Hunks and hits are swept in one order: the nearest
    hit is the last one before a hunk's start or the first one from there on, so no hunk is paired with all hits."""
    marks = hunks.select(*keys, "hunk", "start", "lines", F.col("start").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__line"))
    marks = marks.unionByName(hits.distinct().select(*keys, F.lit(None).cast("int").alias("hunk"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("lines"), F.col("line").alias("__at"), F.lit(1).alias("__kind"), F.col("line").alias("__line")))
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    before = F.last("__line", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("__line", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    end = F.col("start") + F.greatest(F.col("lines"), F.lit(1)) - 1
    told = marks.select("*", before.alias("__b"), after.alias("__a")).where("__kind = 0")
    near = F.least(F.col("start") - F.col("__b"), F.when(F.col("__a") > end, F.col("__a") - end).when(F.col("__a").isNotNull(), 0))  # a null is left out
    return told.select(*keys, "hunk", "start", "lines", F.coalesce(near, F.lit(none) + F.col("hunk")).cast("long").alias("distance"))


def anchor_calls(calls: DataFrame, newest: DataFrame) -> DataFrame:
    """calls (iid, pos, tool, path) as queries that survive drift: a call on the newest file of a series asks for
    the newest one, any other for its path; repeats of a query keep their first place. newest: series, path."""
    told = calls.join(newest.select("path", "series"), "path", "left")
    role = F.when(F.col("series").isNotNull(), F.concat(F.lit("newest "), F.col("series"))).otherwise(F.concat(F.lit("path "), F.col("path")))
    rows = told.select("iid", "pos", F.concat_ws(" ", "tool", role).alias("query"))
    return rows.groupBy("iid", "query").agg(F.min("pos").alias("pos"))


def guard_states(worlds: DataFrame) -> DataFrame:
    """The states that guards compare, per snapshot of worlds (idx, path, sha): of the contents (filehash) and of the
    names of the files alone (manifest)."""
    files = F.sort_array(F.collect_list(F.struct("path", "sha")))
    one = worlds.groupBy("idx").agg(files.alias("f"))
    content = scalar.fingerprint(F.transform("f", lambda x: F.concat_ws("=", x["path"], x["sha"])))
    return one.select("idx", content.alias("filehash"), scalar.fingerprint(F.transform("f", lambda x: x["path"])).alias("manifest"))


#: Bytes of a difference that one verdict is asked for, and of a final one after screening.
SINGLE, FINAL = 12 * 1024, 20 * 1024


def verdict_plan(delta_bytes, screened_bytes):
    """How a difference is judged: in one piece, by screening its parts first, or not at all."""
    return F.when(delta_bytes <= SINGLE, "single").when(screened_bytes <= FINAL, "hierarchical").otherwise("too_large")
