"""Queries of differences: hunks, their distance from what an answer cites, and groups of bounded size."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import evidence, groups
from palimpsest.plans.base import query, table

#: Lines are numbered, so that none is like another, and every eleventh (from the fifth) is changed.
_LINES = """d as (select doc_id, list_transform(string_split(text, chr(10)), lambda x, i: '<' || i || '> ' || x) as l from documents where text is not null),
  spots as (select doc_id, len(l) as n, unnest(list_filter(range(len(l)), lambda i: i % 11 = 5)) as i from d),
  hunks as (select doc_id, row_number() over (partition by doc_id order by i) - 1 as hunk, greatest(i - 2, 0) as start, least(i + 2, n - 1) - greatest(i - 2, 0) + 1 as lines from spots)"""


def _pairs(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("<"), (i + 1).cast("string"), F.lit("> "), x))
    d = d.select("doc_id", "source", lines.alias("l"))
    new = F.transform("l", lambda x, i: F.when(i % 11 == 5, F.concat(F.lit("changed "), x)).otherwise(x))
    return d.select("doc_id", "source", F.array_join("l", "\n").alias("old"), F.array_join(new, "\n").alias("new"), "l")


@query(
    f"""with {_LINES}, hits as (select doc_id, unnest(list_filter(range(len(l)), lambda i: i % 13 = 3)) as line from d),
    j as (select h.*, min(case when line between start and start + lines - 1 then 0 else least(abs(line - start), abs(line - start - lines + 1)) end) as distance from hunks h left join hits using (doc_id) group by all)
    select doc_id, hunk::integer as hunk, start, lines, coalesce(distance, 1000000 + hunk)::bigint as distance from j"""
)
def hunk_distances(spark, sf):
    """Each hunk's distance from the nearest line that the answer cites."""
    pairs = _pairs(spark, sf)
    hunks = evidence.hunk_rows(pairs, ["doc_id"], "old", "new")
    cites = pairs.select("doc_id", F.explode(F.filter("l", lambda x, i: i % 13 == 3)).alias("cite")).withColumn("cite", F.trim("cite"))
    hits = evidence.citation_hits(pairs.select("doc_id", "old"), cites, ["doc_id"], "old")
    return evidence.nearest_hits(hunks.select("doc_id", "hunk", "start", "lines"), hits, ["doc_id"])


#: Lines of each source in the order of documents, with a header for each stretch of one document.
_ITEMS = """i as (select source, doc_id, row_number() over (partition by source order by doc_id, k) as r, greatest(length(line) + 1, 1) as size, length('### ' || doc_id) + 2 as header
    from (select source, doc_id, unnest(l) as line, unnest(range(len(l))) as k from (select source, doc_id, string_split(text, chr(10)) as l from documents where text is not null)))"""


@query(
    f"""with recursive {_ITEMS}, g(source, r, doc_id, grp, total, n) as (
      select source, r, doc_id, 0::bigint, (size + header)::bigint, 1::bigint from i where r = 1
      union all
      select i.source, i.r, i.doc_id, case when fits then grp else grp + 1 end, case when fits then total + add else i.size + i.header end::bigint, case when fits then n + 1 else 1 end
      from (select g.*, i.size, i.header, i.r as nr, i.doc_id as nd, i.size + case when i.doc_id = g.doc_id then 0 else i.header end as add, total + i.size + case when i.doc_id = g.doc_id then 0 else i.header end <= 12288 as fits
        from g join i on i.source = g.source and i.r = g.r + 1) x join i on i.source = x.source and i.r = x.nr)
    select source, grp as "group", count(*) as n_items, sum(size)::bigint as total from g join i using (source, r) group by 1, 2"""
)
def delta_groups(spark, sf):
    """Lines of a source's documents in groups of at most 12 KB, a document's header before each stretch of its lines."""
    d = table(spark, sf, "documents").where("text is not null").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    items = d.select("source", "doc_id", "k", (F.length("line") + 1).alias("size"), (F.length(F.concat(F.lit("### "), F.col("doc_id").cast("string"))) + 2).alias("header"))
    told = groups.grouped(items, "source", ["doc_id", "k"], "size", evidence.SINGLE, "doc_id", "header")
    return told.groupBy("source", "group").agg(F.count(F.lit(1)).alias("n_items"), F.sum("size").cast("long").alias("total"))


@query(
    """with recursive i as (select source, row_number() over (partition by source order by doc_id) as r, least(length(coalesce(text, '')), 12288) as size from documents),
    g(source, r, grp, total) as (
      select source, r, 0::bigint, size::bigint from i where r = 1
      union all select i.source, i.r, case when total + size <= 12288 then grp else grp + 1 end, case when total + size <= 12288 then total + size else size end from g join i on i.source = g.source and i.r = g.r + 1)
    select g.source, grp as "group", count(*) as n_items, sum(size)::bigint as total from g join i using (source, r) group by 1, 2"""
)
def capped_document_groups(spark, sf):
    """The groups themselves that grouped_items adds up."""
    d = table(spark, sf, "documents").select("source", "doc_id", F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(12288)).alias("size"))
    return evidence.capped_groups(d, "source", "doc_id", "size", 12288)
