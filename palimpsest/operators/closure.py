"""What a unit depends on, directly or not, while dependencies come and go, and the state that follows from it.

Dependencies are edges with the snapshots in which they hold. A unit reaches another from when to
when a chain of edges does, so closures are rows with bounds, too; the state of a unit at every
snapshot is an order-independent hash over the contents of all that it reaches, running over the
change log. A unit is evaluated once per state, however many snapshots share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import steps
from palimpsest.sources.working import kept

#: Where an open end lies.
OPEN = 1 << 62


def coalesced(spans: DataFrame, by: list[str]) -> DataFrame:
    """Spans (by..., valid_from, valid_to, not null) that touch or overlap as one."""
    w = Window.partitionBy(*by).orderBy("valid_from", "valid_to")
    before = F.max("valid_to").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (before.isNull() | (F.col("valid_from") > before)).cast("int")
    island = spans.withColumn("__new", fresh).withColumn("__i", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "__i").agg(F.min("valid_from").alias("valid_from"), F.max("valid_to").alias("valid_to")).drop("__i")


def reach(edges: DataFrame) -> DataFrame:
    """edges (unit, dep, valid_from, valid_to) to all that a unit reaches, itself not: unit, dep, valid_from, valid_to (null
    where it still holds). Each round joins what is new with the edges, and keeps what wasn't covered before, so
    that chains of any length and circles end; a round's join is on the unit in the middle."""
    e = kept(coalesced(edges.select("unit", "dep", "valid_from", F.coalesce("valid_to", F.lit(OPEN)).alias("valid_to")), ["unit", "dep"]))
    by = ["unit", "dep"]
    known, fresh = e, e
    step = e.select(F.col("unit").alias("dep"), F.col("dep").alias("next"), F.col("valid_from").alias("a"), F.col("valid_to").alias("b"))
    while True:
        longer = fresh.join(step, "dep").select("unit", F.col("next").alias("dep"), F.greatest("valid_from", "a").alias("valid_from"), F.least("valid_to", "b").alias("valid_to")).where("valid_from < valid_to")
        both = kept(coalesced(known.unionByName(longer), by))
        fresh = kept(both.join(known, [*by, "valid_from", "valid_to"], "left_anti"))
        if fresh.isEmpty():
            break
        known = both
    return known.withColumn("valid_to", F.when(F.col("valid_to") < OPEN, F.col("valid_to")))


def states(contents: DataFrame, edges: DataFrame) -> DataFrame:
    """contents (unit, sha, valid_from, valid_to) and edges (unit, dep, valid_from, valid_to) to each unit's state over time:
    unit, valid_from, valid_to, state, n (contents that it is made of), evaluate (the state's first time)."""
    own = contents.select("unit", F.col("unit").alias("dep"), F.col("valid_from").alias("a"), F.col("valid_to").alias("b")).withColumns({"a": F.lit(0).cast("long"), "b": F.lit(None).cast("long")}).distinct()
    all_ = reach(edges).where("unit <> dep").withColumnsRenamed({"valid_from": "a", "valid_to": "b"}).unionByName(own)
    one = F.conv(F.substring(F.md5(F.concat_ws("=", F.col("dep").cast("string"), "sha")), 1, 15), 16, 10).cast("decimal(38,0)")
    held = all_.join(contents.withColumnRenamed("unit", "dep"), "dep")
    spans = held.select("unit", one.alias("state"), F.greatest("valid_from", "a").alias("valid_from"), F.least("valid_to", "b").alias("valid_to")).where("valid_to is null or valid_from < valid_to")
    told = steps.totals(spans, ["unit"], ["state"]).withColumnRenamed("n_files", "n")
    w = Window.partitionBy("unit").orderBy("valid_from")
    moved = ~F.lag(F.struct("state", "n")).over(w).eqNullSafe(F.struct("state", "n"))
    points = told.withColumn("moved", moved).where("moved").withColumn("valid_to", F.lead("valid_from").over(w)).drop("moved")
    return points.where("n > 0").withColumn("evaluate", F.row_number().over(Window.partitionBy("unit", "state", "n").orderBy("valid_from")) == 1)
