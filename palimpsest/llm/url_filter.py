"""URL filtering by host and path rules, with DataFrame functions only.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and
whose path starts with the rule's path. Each URL is expanded into its host suffixes at label
borders, each with its path prefixes; only suffixes and prefixes of lengths that some rule
has are made. The expressions meet the rules by an equi-join on the first 32 bits of their
SHA-256; of those that meet, the whole digest is compared. Of the rules that fit, the longest
one wins (code points of host and path together, then of the host; block wins over allow in
two rules that are otherwise equal); a URL that none fits gets the default verdict.

A host suffix and a path prefix of given lengths are one string of a URL, so the winner is
known by its two lengths: what is aggregated per row is one long, combined where the row was
read, and the rules' texts never move. Rules that are small (checked) are broadcast; more of
them are joined by salted keys. The distinct lengths go to the driver: k of them take rules of
at least k * k / 2 characters, so a gigabyte of rules has fewer than 50,000.

Defined cases: a null URL, or one without ``://``, has an empty host and path; a port or user
belongs to the host; a null host or path of a rule is empty; a rule with an empty host fits an
empty host and hosts that end with a dot; any verdict but ``block`` allows; without rules every
URL gets the default; repeated rows stay; an empty table gives no rows; further columns are
ignored. Only the characters A to Z of a host are lower-cased, in rules as in URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import join_table, load, pick, small

#: Verdict where no rule fits.
DEFAULT = "allow"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host and path of a URL, both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _short(digest: Column) -> Column:
    """The first 32 bits of a digest in hexadecimals, as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def rule_index(rules: DataFrame) -> DataFrame:
    """rules (host, path, verdict) by digest: hl, pl (their lengths), digest, prefix, blocks (0 or 1)."""
    clean = pick(rules, "host", "path", "verdict").select(
        lower_ascii(F.coalesce(F.col("host").cast("string"), F.lit(""))).alias("host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.coalesce(F.col("verdict") == "block", F.lit(False)).cast("long").alias("blocks"),
    )
    one = clean.groupBy("host", "path").agg(F.max("blocks").alias("blocks")).withColumn("digest", _digest(F.concat("host", "path")))
    return one.select(F.char_length("host").alias("hl"), F.char_length("path").alias("pl"), "digest", _short(F.col("digest")).alias("prefix"), "blocks")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """pages (page_id, url) with host, path, rule (of the winner, else null) and verdict."""
    index = rule_index(rules)
    sizes = index.agg(F.sort_array(F.collect_set("hl")).alias("h"), F.sort_array(F.collect_set("pl")).alias("p")).first()
    lengths = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    host, path = host_and_path(F.col("url"))
    rows = pick(pages, "page_id", "url").withColumn("__part", F.spark_partition_id()).withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    n = F.char_length("host")
    suffixes = F.filter(lengths(sizes.h), lambda l: (l == n) | ((l < n) & (F.substr(F.col("host"), n - l, F.lit(1)) == ".")))
    prefixes = F.filter(lengths(sizes.p), lambda l: l <= F.char_length("path"))
    shapes = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("hl"), p.alias("pl")))))
    # a row without any expression still gives one row; pos tells each row's first
    made = rows.select("__part", "page_id", "url", "host", "path", F.posexplode_outer(shapes).alias("pos", "shape"))
    made = made.select("__part", "page_id", "url", (F.coalesce("pos", F.lit(0)) == 0).cast("long").alias("first"), F.col("shape.hl").alias("hl"), F.col("shape.pl").alias("pl"), _digest(F.concat(F.substr(F.col("host"), n - F.col("shape.hl") + 1), F.substr(F.col("path"), F.lit(1), F.col("shape.pl")))).alias("digest"))
    made = made.withColumn("prefix", _short(F.col("digest")))
    table = index.groupBy("prefix").agg(F.collect_list(F.struct("digest", "blocks")).alias("alike"))
    met = join_table(made, table, ["prefix"], "left", known_small=small(index))
    same = F.filter("alike", lambda r: r["digest"] == F.col("digest"))
    total = (F.col("hl") + F.col("pl")).cast("long")
    code = F.when(F.size(same) > 0, F.shiftleft(total, 32) + F.col("hl") * 2 + F.element_at(same, 1)["blocks"])
    best = met.withColumn("code", code).groupBy("__part", "page_id", "url").agg(F.max("code").alias("code"), F.sum("first").alias("copies"))
    best = best.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    won = F.shiftright(F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int")  # code points of the winner's host
    whole = F.shiftright("code", 32).cast("int")
    out = best.select("page_id", "url", "code", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule = F.concat(F.substr(F.col("host"), F.char_length("host") - won + 1), F.substr(F.col("path"), F.lit(1), whole - won))
    verdict = F.when(F.col("code").isNull(), F.lit(default)).when(F.col("code").bitwiseAND(F.lit(1)) == 1, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.when(F.col("code").isNotNull(), rule).alias("rule"), verdict.alias("verdict"), "url")


#: The rules of the query: host, path, verdict.
RULES = "values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules."""
    return judge(load(spark, sf_dir, "pages"), spark.sql(f"select * from {RULES} as t(host, path, verdict)")).drop("url")


SQL = rf"""
with rules(rhost, rpath, rverdict) as ({RULES}),
u as (
  select page_id, row_number() over () as k,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages
), w as (
  select k, any_value(page_id) as page_id, any_value(host) as host, any_value(path) as path,
    max({{'total': length(rhost) + length(rpath), 'host': length(rhost), 'verdict': rverdict, 'rule': rhost || rpath}}) filter (where rhost is not null) as won
  from u left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by k
)
select page_id, host, path, won.rule as rule, coalesce(won.verdict, '{DEFAULT}') as verdict from w
"""
