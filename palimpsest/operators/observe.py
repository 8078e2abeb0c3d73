"""Read-only observations of the files at a snapshot: listings, searches, schemas, heads,
statistics, and one guarded SELECT. Each returns a DataFrame; ``render`` gives capped text.
"""

from __future__ import annotations

import inspect
import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import scalar

CAP = 4000
LITERAL = re.compile(r"'([^']+\.(?:parquet|csv|txt|md|json))'")


class Refused(ValueError):
    """A query that the guard doesn't let through."""


def ls(files: DataFrame, path: str = ".") -> DataFrame:
    """Direct children of a folder: name (folders end in /) and how many files it holds."""
    prefix = "" if path in (".", "") else path.strip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 20)
    head = F.substring_index(rest, "/", 1)
    name = F.when(head == rest, head).otherwise(F.concat(head, F.lit("/")))
    return files.where(F.col("path").startswith(prefix)).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n_files"))


#: How many entries the text of a listing, a search of names and a search of lines shows.
SHOWN = {"ls": 200, "find": 150, "grep": 60}


def listed(kind: str, rows: DataFrame, order: list[str], line) -> str:
    """The text of an observation: its first entries in order, and a mark if there are more; an error if there is none."""
    most = SHOWN[kind]
    got = [r[0] for r in rows.orderBy(*order).select(line.alias("line")).limit(most + 1).collect()]
    if not got:
        return "ERROR: nothing found"
    return "\n".join(got[:most]) + (f"\n... [more than {most}]" if len(got) > most else "")


def find(files: DataFrame, glob: str) -> DataFrame:
    """Paths that match a shell pattern."""
    return files.where(scalar.glob_matches(F.col("path"), glob)).select("path")


def text_lines(texts: DataFrame) -> DataFrame:
    """texts (path, text) as numbered lines, from 1; any newline convention."""
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    return texts.select("path", F.posexplode(lines).alias("n", "line")).select("path", (F.col("n") + 1).alias("line_no"), "line")


def grep(texts: DataFrame, pattern: str) -> DataFrame:
    """Lines that match: path, line_no, line (its first 200 characters)."""
    hits = text_lines(texts.where(F.col("text").rlike(f"(?m){pattern}"))) if not pattern.startswith("(?") else text_lines(texts)
    return hits.where(F.col("line").rlike(pattern)).select("path", "line_no", F.substring("line", 1, 200).alias("line"))


def grep_count(texts: DataFrame, pattern: str) -> DataFrame:
    """Matching lines of each text that has any."""
    return grep(texts, pattern).groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def read_text(texts: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 200) -> DataFrame:
    """Numbered lines of one text; 120 by default, never more than ``most``."""
    start = max(1, start)
    end = min(start + 119 if end is None else end, start + most - 1)
    return text_lines(texts.where(F.col("path") == path)).where(F.col("line_no").between(start, end)).select("line_no", "line")


def head(rows: DataFrame, order: list[str], n: int = 20) -> DataFrame:
    return rows.orderBy(*order).limit(min(n, 20))


def stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: least and greatest value as text, nulls, rows; one scan for all."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        aggs += [F.min(c).cast("string").alias(f"lo{i}"), F.max(c).cast("string").alias(f"hi{i}"), F.count_if(F.col(c).isNull()).alias(f"no{i}")]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"), F.col(f"no{i}").alias("null_count"), F.col("n_rows")) for i, c in enumerate(columns)])
    return one.select(F.inline(each))


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns (pos, name, type) of two file versions: what was added, removed, retyped or renamed in case alone."""
    x = a.select(F.col("name").alias("old_name"), F.col("type").alias("old_type"), F.lower("name").alias("k1"))
    y = b.select(F.col("name").alias("new_name"), F.col("type").alias("new_type"), F.lower("name").alias("k2"))
    j = x.join(y, F.col("k1") == F.col("k2"), "full_outer")
    change = (
        F.when(F.col("old_name").isNull(), "added")
        .when(F.col("new_name").isNull(), "removed")
        .when(F.col("old_name") != F.col("new_name"), "renamed")
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    )
    return j.select(F.coalesce("old_name", "new_name").alias("name"), change.alias("change"), "old_type", "new_type").where("change is not null")


def same_order(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of the columns (pos, name) that two file versions share: how many, and whether their order is the same."""
    j = a.select("name", F.col("pos").alias("i")).join(b.select("name", F.col("pos").alias("k")), "name")
    rank = lambda c: F.row_number().over(Window.orderBy(c))  # noqa: E731  (columns are few)
    return j.select(rank("i").alias("x"), rank("k").alias("y")).agg(F.count(F.lit(1)).alias("n_shared"), F.coalesce(F.bool_and(F.col("x") == F.col("y")), F.lit(True)).alias("same_order"))


def guarded_sql(spark: SparkSession, query: str, files: dict[str, DataFrame], sizes: dict[str, int], most_files: int = 3, most_rows: int = 1_200_000, show: int = 50, seconds: int = 30) -> tuple[DataFrame, bool]:
    """One read-only SELECT over logical file names written as string literals.

    The parsed plan must be a query (no command, no write); it must name at least one known
    file and stay within the budget of files and rows, which is checked before it runs. The
    job is cancelled after ``seconds``. Returns up to ``show`` rows and whether there were more.
    """
    if ";" in query.rstrip().rstrip(";") or re.search(r"https?://|s3://|\bread_\w+\s*\(", query, re.I):
        raise Refused("one SELECT over known files only")
    names = list(dict.fromkeys(m for m in LITERAL.findall(query) if m in files))
    if not names:
        raise Refused("the query names no known file")
    if len(names) > most_files or sum(sizes[n] for n in names) > most_rows:
        raise Refused(f"budget: at most {most_files} files and {most_rows} rows")
    text = query.rstrip().rstrip(";")
    for n in names:  # a file stands after FROM, JOIN or a comma between them; elsewhere its name is a string
        view = f"__file_{uuid.uuid4().hex}"
        files[n].createOrReplaceTempView(view)
        text = re.sub(rf"(\b(?:from|join)\s+(?:{LITERAL.pattern}\s*(?:as\s+)?\w*\s*,\s*)*)'{re.escape(n)}'", rf"\g<1>{view}", text, flags=re.I)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"not a query: {e}") from None
    commands = ("Insert", "Create", "Drop", "Alter", "Set", "Add", "Cache", "Load", "Truncate", "Delete", "Update", "Merge", "Show", "Describe", "Refresh", "Use", "Analyze", "Command")
    kind = plan.getClass().getSimpleName()
    if kind.startswith(commands) or kind.endswith("Command") or not re.match(r"\s*(with|select|\(|from|values)\b", text, re.I):
        raise Refused("only a SELECT is let through")
    group = f"guarded-{id(plan)}"
    spark.sparkContext.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer = threading.Timer(seconds, lambda: spark.sparkContext.cancelJobGroup(group))
    timer.start()
    try:
        rows = spark.sql(text).limit(show + 1)
        got = rows.collect()  # at most show + 1 rows
    finally:
        timer.cancel()
        for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            spark.sparkContext.setLocalProperty(key, None)
    return spark.createDataFrame(got[:show], rows.schema), len(got) > show


def has_order(query: str) -> bool:
    """Whether a query fixes the order of its rows."""
    return re.search(r"\border\s+by\b", query, re.I) is not None


def render(rows: DataFrame, cap: int = CAP) -> str:
    """Tab-separated text of a small result, cut at ``cap`` characters with a mark."""
    got = rows.collect()
    text = "\n".join(["\t".join(rows.columns), *("\t".join("NULL" if v is None else str(v) for v in r) for r in got)])
    return text if len(text) <= cap else text[:cap] + f"\n... [{len(text) - cap} more characters]"


#: Characters of a name's start by which patterns without a folder meet names, and copies of a pattern
#: over which the paths that it meets are spread.
START, SPREAD = 8, 16


def ancestors(path: Column) -> Column:
    """The folders above a path, each ending in /."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    return F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>"))


def is_glob(item: Column) -> Column:
    return item.rlike(r"[*?\[]")


def glob_matches(patterns: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct patterns (item) and the paths (path) that match them: item, path.

    A pattern meets only paths in the folder that it begins with, or, without a folder, names that begin
    as it does (up to START characters); what begins with a wildcard is spread over SPREAD tasks.
    """
    item = F.col("item")
    literal = F.regexp_extract(item, r"^[^*?\[]*", 0)
    folder = F.regexp_extract(literal, r"^(.*/)?", 0)
    key = F.when(item.contains("/"), F.concat(F.lit("d"), folder)).otherwise(F.concat(F.lit("b"), F.substring(literal, 1, START)))
    asked = patterns.select("item").distinct().select("item", key.alias("key"), scalar.glob_pattern(item).alias("regex"), F.explode(F.array(*[F.lit(i) for i in range(SPREAD)])).alias("salt"))
    name = scalar.basename(F.col("path"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(START)), lambda n: F.concat(F.lit("b"), F.left(name, n)))
    keys = F.array_distinct(F.concat(F.array(F.lit("d")), F.transform(ancestors(F.col("path")), lambda f: F.concat(F.lit("d"), f)), starts))
    held = paths.select("path").distinct().select("path", F.explode(keys).alias("key")).withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SPREAD)).cast("int"))
    text = F.when(F.startswith("key", F.lit("d")), F.col("path")).otherwise(scalar.basename(F.col("path")))
    return asked.join(held, ["key", "salt"]).where(F.rlike(text, F.col("regex"))).select("item", "path")


def read_set(calls: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that each observation depends on. calls: iid, item (a path, a folder ending in / or a shell pattern)."""
    folder, pattern = F.col("item").endswith("/"), is_glob(F.col("item"))
    plain = calls.where(~folder & ~pattern).join(files.select("path"), F.col("item") == F.col("path")).select("iid", "path")
    # a folder is a prefix that ends at one of a path's slashes
    above = files.select("path", F.explode(ancestors(F.col("path"))).alias("item"))
    inside = calls.where(folder).join(above, "item").select("iid", "path")
    # each pattern meets the paths of its folder once, however many calls have it
    wide = calls.where(~folder & pattern)
    return plain.unionByName(inside).unionByName(wide.join(glob_matches(wide, files), "item").select("iid", "path")).distinct()


def label(tool, argument):
    """A call as text, for people."""
    return F.concat(tool, F.lit("("), argument, F.lit(")"))


def tools() -> list[dict]:
    """The observations as tools: name, description and parameters (name, type, required) from their signatures."""
    out = []
    for f in (ls, find, grep, grep_count, read_text, head, stats, schema_diff, guarded_sql):
        parameters = [(n, p) for n, p in inspect.signature(f).parameters.items() if "DataFrame" not in str(p.annotation) and "SparkSession" not in str(p.annotation)]
        out.append({"name": f.__name__, "description": (f.__doc__ or "").split("\n")[0], "parameters": [{"name": n, "type": str(p.annotation), "required": p.default is p.empty} for n, p in parameters]})
    return out


def call(name: str, given: dict, **bound):
    """Run an observation by name: arguments that it doesn't know are left out; an unknown name is refused."""
    known = {f.__name__: f for f in (ls, find, grep, grep_count, read_text, head, stats, schema_diff, guarded_sql)}
    if name not in known:
        raise Refused(f"no observation is called {name!r}")
    names = inspect.signature(known[name]).parameters
    return known[name](**{k: v for k, v in {**given, **bound}.items() if k in names})


def canonical_rows(rows: DataFrame, query: str) -> DataFrame:
    """A result in an order that doesn't depend on the run: its own if the query fixes one, else that of its values as text."""
    return rows if has_order(query) else rows.orderBy(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")) for c in rows.columns])
