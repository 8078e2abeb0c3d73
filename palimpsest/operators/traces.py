"""Whole traces of calls as queries that survive drift, and what those queries observe at every snapshot.

Anchoring looks at a trace as a whole: of what a listing showed, only the entries that other calls
of the trace used are kept, and the roles they had (the newest or oldest of a series, or a number of
entries that was the answer); a call on the newest file of a series asks for the newest file.

Observing resolves each query at all snapshots at once through the intervals in which file versions
hold, and evaluates each distinct pair of a question and the contents it depends on once, from
profiles of versions; statistics of the parts of a partition are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar
from palimpsest.operators import manifest, steps
from palimpsest.operators.observe import SHOWN, ancestors, glob_matches, is_glob
from palimpsest.sources.working import kept

def order_key(path: str = "path"):
    """What files of a series are ordered by: four-digit numbers, other numbers, the path."""
    numbers = F.regexp_extract_all(path, F.lit(r"(\d+)"))
    rest = F.transform(F.filter(numbers, lambda x: F.length(x) != 4), lambda x: x.cast("decimal(38,0)"))
    return F.struct(F.filter(numbers, lambda x: F.length(x) == 4).alias("years"), rest.alias("rest"), F.col(path).alias("path"))


def first_calls(calls: DataFrame) -> DataFrame:
    """Calls (iid, pos, tool, path, text) without repeats: the first place of each."""
    return calls.groupBy("iid", "tool", "path", "text").agg(F.min("pos").alias("pos"))


def listings(calls: DataFrame, files: DataFrame) -> DataFrame:
    """What distinct listings (tool ls or find, path) show: tool, path, entry (a folder ends in /), shown (whether
    within the tool's limit)."""
    asked = calls.where(F.col("tool").isin("ls", "find")).select("tool", "path").distinct()
    whole = F.col("path")
    above = F.concat(F.array(F.lit("")), ancestors(whole))
    # each path is an entry of its folder, and each of its folders one of the folder above
    entries = F.concat(ancestors(whole), F.array(whole))
    held = files.select("path").distinct().select(F.explode(F.arrays_zip(above.alias("folder"), entries.alias("entry"))).alias("e")).select("e.folder", "e.entry").distinct()
    scope = F.regexp_replace(scalar.normal_path(F.col("path")), r"/+$", "")
    scope = F.when(scope.isin("", "."), "").otherwise(F.concat(scope, F.lit("/")))
    below = asked.where("tool = 'ls'").withColumn("folder", scope).join(held, "folder").select("tool", "path", "entry")
    globs = asked.where("tool = 'find'")
    found = glob_matches(globs.select(F.col("path").alias("item")), files).select(F.lit("find").alias("tool"), F.col("item").alias("path"), F.col("path").alias("entry"))
    rows = below.unionByName(found)
    n = F.row_number().over(Window.partitionBy("tool", "path").orderBy("entry"))
    return rows.withColumn("shown", n <= F.when(F.col("tool") == "ls", SHOWN["ls"]).otherwise(SHOWN["find"]))


def _references(calls: DataFrame) -> DataFrame:
    """What calls name: iid, pos, item (a path, a pattern, or a folder ending in / that lies above one or is listed)."""
    literals = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"'([^']*)'"), 1)
    named = F.array_compact(F.concat(F.array("path"), literals))
    rows = calls.select("iid", "pos", "tool", F.explode(named).alias("raw")).withColumn("bare", F.regexp_replace(scalar.normal_path(F.col("raw")), r"/+$", ""))
    itself = F.when(F.col("tool") == "ls", F.concat("bare", F.lit("/"))).otherwise(F.col("bare"))
    return rows.select("iid", "pos", F.explode(F.array_distinct(F.concat(F.array(itself), ancestors(F.col("bare"))))).alias("item"))


def anchor_traces(calls: DataFrame, files: DataFrame, facts: DataFrame) -> DataFrame:
    """Traces of calls (iid, pos, tool, path, text) over a snapshot's files (path), about facts (iid, question, answer),
    as queries: iid, pos, kind, item.

    Kinds: newest (of a series), file and call (what is asked for by name), and of a listing
    present (an entry that another call used), latest and earliest (a series whose newest or
    oldest entry one of them is), count (a series whose number of entries is the answer).
    """
    calls = first_calls(calls).join(facts.select("iid", F.coalesce("question", F.lit("")).alias("question"), F.trim(F.coalesce("answer", F.lit(""))).alias("answer")), "iid", "left")
    calls = kept(calls.fillna("", ["question", "answer"]))
    refs = kept(_references(calls))
    globs = refs.where(is_glob(F.col("item"))).groupBy("iid", "item").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    matched = kept(glob_matches(globs, files))

    # calls on files: the newest of its series by role, unless a pattern with digits or the question narrows it
    by_file = calls.where(F.col("tool").startswith("file_") | (F.col("tool") == "head")).withColumn("file", scalar.normal_path(F.col("path")))
    newest = files.select("path").distinct().groupBy(scalar.series_pattern(F.col("path")).alias("series")).agg(F.max_by("path", order_key()).alias("file"), F.count(F.lit(1)).alias("n")).where("n >= 2").drop("n")
    narrow = globs.where(F.col("item").rlike(r"\d")).join(matched, "item").select("iid", F.col("path").alias("file"), F.lit(True).alias("narrow")).distinct()
    periods = F.regexp_extract_all(scalar.basename(F.col("file")), F.lit(r"\d{4}(?:-\d{2}){0,2}"), 0)
    asked = F.exists(periods, lambda p: F.contains("question", F.left(p, F.lit(4))))
    told = by_file.join(newest, "file", "left").join(narrow, ["iid", "file"], "left")
    role = F.col("series").isNotNull() & F.col("narrow").isNull() & ~asked
    told = kept(told.withColumn("kind", F.when(role, "newest").otherwise("file")))
    from_files = told.select("iid", "pos", "kind", F.concat_ws(" ", "tool", F.when(F.col("kind") == "newest", F.col("series")).otherwise(F.col("file"))).alias("item"))
    roles = told.where("kind = 'newest'").select("iid", F.explode(F.concat(F.array("file"), ancestors(F.col("file")))).alias("entry")).distinct()

    # listings: what was shown and used by another call
    seen = kept(listings(calls, files))
    shown = calls.where(F.col("tool").isin("ls", "find")).select("iid", "pos", "tool", "path", "question", "answer").join(seen.where("shown").drop("shown"), ["tool", "path"])
    other = lambda first, last: (F.col(first) != F.col("pos")) | (F.col(last) != F.col("pos"))
    by_name = refs.groupBy("iid", F.col("item").alias("entry")).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    by_glob = globs.join(matched, "item").groupBy("iid", F.col("path").alias("entry")).agg(F.min("first").alias("gfirst"), F.max("last").alias("glast"))
    used = shown.join(by_name, ["iid", "entry"], "left").join(by_glob, ["iid", "entry"], "left")
    used = used.withColumn("used", F.coalesce(other("first", "last"), F.lit(False)) | F.coalesce(other("gfirst", "glast"), F.lit(False)))
    # where nothing was used, the listing itself may have told the answer
    any_ = F.max("used").over(Window.partitionBy("iid", "pos"))
    itself = ~any_ & (F.length("answer") >= 4) & F.contains("entry", F.col("answer"))
    stay = used.withColumn("stays", F.col("used") | itself).where("stays").join(roles, ["iid", "entry"], "left_anti").select("iid", "pos", "tool", "path", "question", "entry")
    stay = kept(stay.withColumn("series", manifest.named_series(F.col("entry"), F.col("question"))).withColumn("loose", scalar.series_pattern(F.col("entry"))))
    all_ = seen.select("tool", "path", F.col("entry").alias("member"), scalar.series_pattern(F.col("entry")).alias("loose"))
    like = F.concat(F.lit("^"), F.replace(F.regexp_replace("series", r"([.+*?^$(){}|\[\]\\])", r"\\$1"), F.lit("#"), F.lit(r"\d+")), F.lit("$"))
    among = stay.join(all_, ["tool", "path", "loose"]).where(F.rlike(F.col("member"), like))
    ends = kept(among.groupBy("iid", "pos", "entry", "series").agg(F.max_by("member", order_key("member")).alias("newest"), F.min_by("member", order_key("member")).alias("oldest"), F.count(F.lit(1)).alias("n")).where("n >= 2"))
    number = shown.where(F.col("answer").rlike(r"^\d+$")).select("iid", "pos", "tool", "path", scalar.series_pattern(F.col("entry")).alias("loose"), "answer").distinct()
    sizes = all_.groupBy("tool", "path", "loose").agg(F.count(F.lit(1)).alias("n"))
    counted = number.join(sizes, ["tool", "path", "loose"]).where(F.col("n") == F.col("answer").cast("decimal(38,0)"))

    rest = calls.where(~F.col("tool").isin("ls", "find", "head") & ~F.col("tool").startswith("file_"))
    out = from_files.unionByName(rest.select("iid", "pos", F.lit("call").alias("kind"), F.concat_ws(" ", "tool", F.coalesce("text", "path")).alias("item")))
    out = out.unionByName(stay.select("iid", "pos", F.lit("present").alias("kind"), F.col("entry").alias("item")))
    for kind, column in (("latest", "newest"), ("earliest", "oldest")):
        out = out.unionByName(ends.where(F.col(column) == F.col("entry")).select("iid", "pos", F.lit(kind).alias("kind"), F.col("series").alias("item")).distinct())
    return out.unionByName(counted.select("iid", "pos", F.lit("count").alias("kind"), F.col("loose").alias("item")))


MISSING = "error: no such file"
DIFFER = "error: part files of this partition have different schemas"


def resolved(queries: DataFrame, files: DataFrame) -> DataFrame:
    """The file versions that queries (query, target) on a path mean, over time: the path itself, while it is there;
    else the parts of the partition that it names; else the only file of its name. files: path, sha, part,
    valid_from, valid_to. Gives query, path, sha, valid_from, valid_to, each stretch with all its files."""
    span = ["path", "sha", "valid_from", "valid_to"]
    name = scalar.basename(F.col("path"))
    part = F.regexp_extract("target", r"(\d{4}-\d{2})", 1)
    exact = queries.join(files, F.col("target") == F.col("path")).select("query", F.lit(1).alias("level"), *span)
    by_part = queries.where(part != "").join(files, part == F.col("part")).select("query", F.lit(2).alias("level"), *span)
    by_name = queries.join(files, scalar.basename(F.col("target")) == name).select("query", F.lit(3).alias("level"), *span)
    spans = exact.unionByName(by_part).unionByName(by_name)
    # how many files of each level hold, as steps of each query: they say which level counts from when on
    levels = spans.withColumns({f"n{i}": (F.col("level") == i).cast("long") for i in (1, 2, 3)})
    counts = steps.totals(levels, ["query"], ["n1", "n2", "n3"])
    chosen = F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).when(F.col("n3") == 1, 3)
    held = counts.select("query", chosen.alias("level"), F.col("valid_from").alias("a"), F.col("valid_to").alias("b")).where("level is not null")
    both = spans.join(held, ["query", "level"]).where((F.col("valid_from") <= F.col("a")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("a"))))
    return both.select("query", "path", "sha", F.col("a").alias("valid_from"), F.col("b").alias("valid_to"))


def ends_of(queries: DataFrame, files: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The newest and the oldest member of the series (target) of queries (query, target, oldest) at every snapshot:
    query, idx, path, sha."""
    asked = queries.select("target", "oldest").distinct()
    members = asked.join(files.withColumn("target", scalar.series_pattern(F.col("path"))), "target")
    up = F.row_number().over(Window.partitionBy("target", "oldest").orderBy(order_key().asc()))
    down = F.row_number().over(Window.partitionBy("target", "oldest").orderBy(order_key().desc()))
    places = members.select("target", "oldest", "path").distinct().withColumn("n", F.when(F.col("oldest"), down).otherwise(up).cast("long"))
    spans = members.join(places, ["target", "oldest", "path"]).select("target", "oldest", F.struct("path", "sha").alias("file"), "n", "valid_from", "valid_to")
    top = steps.top_at(kept(spans), ["target", "oldest"], "file", "n", 1, snapshots)
    return queries.join(top, ["target", "oldest"]).select("query", "idx", "file.path", "file.sha")


def observe_at_snapshots(queries: DataFrame, files: DataFrame, versions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What anchored queries observe at every snapshot: query, idx, dep, observation, evaluate.

    queries: query, kind (file, newest, present, latest, earliest, count), tool (of the first two: file_rowcount,
    file_stats, file_schema), target (a path or a series); files: path, sha, part, valid_from, valid_to;
    versions, one row per sha: n_rows, lo, hi, nulls (of the column that is asked about), schema.
    dep is the fingerprint of the contents that it depends on; evaluate says whether the query is asked about
    them for the first time. Each tool sees each set of contents once, whatever queries and snapshots share it.
    """
    kind = lambda *k: queries.where(F.col("kind").isin(*k))
    queries = kept(queries)
    by_path = steps.at(resolved(kind("file"), files), snapshots).select("query", "idx", "path", "sha")
    ends = kept(ends_of(kind("newest", "latest", "earliest").select("query", "target", (F.col("kind") == "earliest").alias("oldest")), files, snapshots))
    of_files = by_path.unionByName(ends.join(kind("newest").select("query"), "query", "left_semi"))
    parts = F.sort_array(F.collect_list(F.struct("path", "sha")))
    deps = of_files.groupBy("query", "idx").agg(parts.alias("parts")).join(queries.select("query", "tool"), "query")
    deps = kept(deps.withColumn("dep", scalar.fingerprint(F.transform("parts", lambda x: F.concat_ws("=", x["path"], x["sha"])))))
    distinct = deps.select("tool", "dep", "parts").distinct().select("tool", "dep", F.explode("parts.sha").alias("sha"))
    merged = distinct.join(versions, "sha").groupBy("tool", "dep").agg(
        F.sum("n_rows").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("nulls").alias("nulls"), F.min("schema").alias("s0"), F.max("schema").alias("s1")
    )
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    text = (
        F.when(F.col("tool") == "file_rowcount", F.col("n").cast("string"))
        .when(F.col("tool") == "file_stats", F.concat(F.lit("rows="), "n", F.lit(" min="), shown("lo"), F.lit(" max="), shown("hi"), F.lit(" null_count="), "nulls"))
        .when(F.col("s0") == F.col("s1"), F.col("s0"))
        .otherwise(F.lit(DIFFER))
    )
    told = deps.join(merged.select("tool", "dep", text.alias("observation")), ["tool", "dep"]).select("query", "idx", "dep", "observation")

    # how many entries there are: of one path (is it there?) or of a series
    entries = kind("present").join(files.withColumnRenamed("path", "target"), "target")
    members = kind("count").join(files.withColumn("target", scalar.series_pattern(F.col("path"))), "target")
    held = entries.select("query", "kind", "valid_from", "valid_to").unionByName(members.select("query", "kind", "valid_from", "valid_to")).withColumn("n", F.lit(1).cast("long"))
    counted = steps.at(steps.totals(held, ["query", "kind"], ["n"]), snapshots).where("n > 0")
    own = counted.select("query", "idx", F.when(F.col("kind") == "present", "present").otherwise(F.col("n").cast("string")).alias("observation"))
    own = own.unionByName(ends.join(kind("latest", "earliest").select("query"), "query", "left_semi").select("query", "idx", F.col("path").alias("observation")))
    told = told.unionByName(own.select("query", "idx", F.lit(None).cast("string").alias("dep"), "observation"))

    # every query has something to say at every snapshot, if only that nothing is there
    last = snapshots.agg(F.sort_array(F.collect_list("idx")).alias("all"))
    every = queries.select("query", "kind").crossJoin(F.broadcast(last)).select("query", "kind", F.explode("all").alias("idx"))  # one row
    nothing = F.when(F.col("kind") == "present", "absent").when(F.col("kind").isin("latest", "earliest"), "(none)").when(F.col("kind") == "count", "0").otherwise(MISSING)
    full = every.join(told, ["query", "idx"], "left").withColumn("observation", F.coalesce("observation", nothing))
    full = full.withColumn("dep", F.coalesce("dep", scalar.value_hash(F.col("observation"))))
    first = F.row_number().over(Window.partitionBy("query", "dep").orderBy("idx")) == 1
    return full.select("query", "idx", "dep", "observation", first.alias("evaluate"))
