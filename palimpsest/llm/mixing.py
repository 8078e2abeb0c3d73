"""Mixing sources to target weights by a time-varying curriculum, with DataFrame
functions only.

Each source has a weight schedule: densities at equally spaced knots of training
time 0..1, linear between them. The integral of a source's schedule is its weight;
weights share the demand among sources, and no source gives more than ``most_passes``
times its size (the excess is shared again by weight until no source is above).
A source's documents stand in a keyed random order; running sums of their sizes give
each taken copy its place in the source's cumulative demand, and inverting the
integrated schedule turns that place into a position in training time, by which the
documents are sorted in ranges.

Running sums use three levels of 1024 hash ranges, so the rows of one source, which
may be a third of all, never meet in one task; nor do rows that repeat one document, which
are numbered first, part by part.

Documents are taken whole: first all copies that end before the source's target, then,
of the documents no larger than what is missing, those that running sums let in, repeated
until nothing fits (those with fewer copies first), and last, if it comes nearer, one more
document whose size is nearest to what is missing.

Defined cases: a null text has size 0; documents of size 0 are never taken; null is a
source of its own, ranked last; ties of the random order are broken by doc_id, size
and text hash, and equal rows are interchangeable (numbered, each has a place of its own); an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import global_rank, join_table, load, materialize, pick, release, scratch, small

#: Densities at the knots, for sources by rank in turn: rising, even, falling. The integrals are 3, 1 and 2.
SCHEDULES = ((1.5, 3.0, 4.5), (1.0, 1.0, 1.0), (3.0, 2.0, 1.0))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\x09-\\x0D; null: 0."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def integral(knots: tuple[float, ...]) -> float:
    """Area below the schedule over training time 0..1."""
    return sum(a + b for a, b in zip(knots, knots[1:])) / 2 / (len(knots) - 1)


def position(knots: Column, share: Column) -> Column:
    """Training time at which a schedule has used up this share (0..1) of its integral."""
    gaps = F.size(knots) - 1
    area = F.transform(F.sequence(F.lit(1), gaps), lambda i: (F.element_at(knots, i) + F.element_at(knots, i + 1)) / 2 / gaps)
    total = F.aggregate(area, F.lit(0.0), lambda a, x: a + x)
    need = share * total
    # (segment from 0, area before it) of the segment in which `need` is reached
    found = F.aggregate(
        area,
        F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("used"), F.lit(False).alias("end")),
        lambda s, x: F.when(s["end"] | (s["used"] + x >= need) | (s["i"] + 1 >= gaps), F.struct(s["i"].alias("i"), s["used"].alias("used"), F.lit(True).alias("end"))).otherwise(
            F.struct((s["i"] + 1).alias("i"), (s["used"] + x).alias("used"), F.lit(False).alias("end"))
        ),
    )
    a, b = F.element_at(knots, found["i"] + 1), F.element_at(knots, found["i"] + 2)
    rest = F.greatest(need - found["used"], F.lit(0.0))
    below = a + F.sqrt(F.greatest(a * a + 2 * (b - a) * gaps * rest, F.lit(0.0)))
    inside = F.when(below > 0, 2 * rest / below).otherwise(F.lit(0.0))
    return F.least(F.greatest(found["i"] / gaps + inside, F.lit(0.0)), F.lit(1.0))


def source_targets(sizes: DataFrame, schedules: tuple = SCHEDULES, demand: float = 1.5, most_passes: float = 2.0) -> DataFrame:
    """Per source: source_size, knots, weight and target (double)."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = global_rank(totals, [F.col("source").asc_nulls_last()], "rank")
    n = len(schedules)
    knots, weight = F.lit(None).cast("array<double>"), F.lit(None).cast("double")
    for i, s in enumerate(schedules):
        here = F.col("rank") % n == i
        knots = F.when(here, F.array(*[F.lit(float(x)) for x in s])).otherwise(knots)
        weight = F.when(here, F.lit(integral(s))).otherwise(weight)
    ranked = materialize(ranked.select("source", "source_size", knots.alias("knots"), weight.alias("weight")))
    most = F.col("source_size") * F.lit(most_passes)
    budget = ranked.agg(F.sum("source_size")).first()[0] or 0
    budget, level = budget * demand, 0.0
    while True:  # each round fixes the sources that reach their bound; ends when none is new
        full = most <= F.col("weight") * level
        r = ranked.agg(F.sum(F.when(full, most)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        new = (budget - (r["fixed"] or 0.0)) / r["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(most.cast("double"), F.col("weight") * F.lit(level)))


def number_twins(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, tie) with `twin`, which counts equal rows from 0.

    Few rows are equal to another, as a rule none. They are numbered within the parts in which
    they are read, and the numbers of the parts before are added, so that the equal rows of
    one document never meet in one task.
    """
    keys = ["doc_id", "source", "size", "tie"]
    several = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("several")).where("several > 1"))
    if several.limit(1).count() == 0:
        return rows.withColumn("twin", F.lit(0).cast("long"))
    marked = materialize(join_table(rows.withColumn("part", F.spark_partition_id()), several, keys, "left"))
    alone = marked.where("several is null").select(*keys, F.lit(0).cast("long").alias("twin"))
    same = marked.where("several is not null")
    here = Window.partitionBy(*keys, "part").orderBy("part")
    parts = same.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy(*keys).orderBy("part")) - F.col("n")).drop("n")
    twins = join_table(same.withColumn("twin", F.row_number().over(here) - 1), materialize(before), [*keys, "part"])
    return alone.union(twins.select(*keys, (F.col("twin") + F.col("before")).alias("twin")))


def place(docs: DataFrame) -> DataFrame:
    """docs (doc_id, source, size, tie, twin) with `start`: the sizes before each in its source's random order."""
    h = F.xxhash64("doc_id", "tie", "twin", F.lit(20240607))
    docs = docs.select("doc_id", "source", "size", "tie", h.alias("h"), F.shiftrightunsigned(h, 54).alias("b1"), F.shiftrightunsigned(h, 44).bitwiseAND(F.lit(1023)).alias("b2"))
    leaf = docs.groupBy("source", "b1", "b2").agg(F.sum("size").alias("sum2"))
    top = leaf.groupBy("source", "b1").agg(F.sum("sum2").alias("sum1"))
    before1 = F.sum("sum1").over(Window.partitionBy("source").orderBy("b1")) - F.col("sum1")
    top = top.select(F.col("source").alias("s"), F.col("b1").alias("c1"), before1.alias("before1"))
    before2 = F.sum("sum2").over(Window.partitionBy("source", "b1").orderBy("b2")) - F.col("sum2")
    leaf = leaf.withColumn("before2", before2).join(top, F.col("source").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("c1")))
    leaf = leaf.select(F.col("source").alias("s"), F.col("b1").alias("c1"), F.col("b2").alias("c2"), (F.col("before1") + F.col("before2")).alias("before"))
    w = Window.partitionBy("source", "b1", "b2").orderBy("h", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inside", F.coalesce(F.sum("size").over(w), F.lit(0)))
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    return docs.join(leaf, on).select("doc_id", "source", "size", "tie", "h", (F.col("before") + F.col("inside")).alias("start"))


def fill(placed: DataFrame, most_passes: int) -> tuple[DataFrame, list[DataFrame]]:
    """What goes on after the first document that does not fit. placed: doc_id, source, size, start,
    copies, target. Gives the gaps left (source, gap, target) and tables of further copies
    (source, start, size, at: their place in the source's demand)."""
    gaps = materialize(placed.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"), F.first("target").alias("target")))
    rest, extra, old = placed.select("doc_id", "source", "size", "start", "copies"), [], []
    few = small(gaps)  # so is any table with a row for each of some sources
    by_source = lambda rows, table, how="inner": join_table(rows, table, ["source"], how, known_small=few)
    while True:
        fits = by_source(rest, gaps.select("source", "gap")).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & (F.col("copies") < most_passes))
        fits = materialize(fits.drop("gap"))
        release(*old)
        if fits.limit(1).count() == 0:
            release(fits)
            return gaps, extra
        now = by_source(fits, fits.groupBy("source").agg(F.min("copies").alias("level"))).where(F.col("copies") == F.col("level"))
        run = place(now.select("doc_id", "source", "size", F.col("start").alias("tie"), F.lit(0).cast("long").alias("twin"))).select("source", "size", "tie", F.col("start").alias("before"))
        run = by_source(run, gaps).where(F.col("before") + F.col("size") <= F.col("gap"))
        extra.append(materialize(run.select("source", F.col("tie").alias("start"), "size", (F.col("target") - F.col("gap") + F.col("before")).alias("at"))))
        less = by_source(gaps, extra[-1].groupBy("source").agg(F.sum("size").alias("sum")), "left")
        old = [fits, gaps]
        gaps = materialize(less.select("source", (F.col("gap") - F.coalesce("sum", F.lit(0))).alias("gap"), "target"))
        rest = join_table(fits, extra[-1].select("source", "start", F.lit(1).alias("more")), ["source", "start"], "left")
        rest = rest.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def plan_mixture(documents: DataFrame, schedules: tuple = SCHEDULES, demand: float = 1.5, most_passes: int = 2, unique: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies (int),
    taken (long: copies times size) and positions (array of training times of its copies).
    unique: no two rows have the same doc_id, so none has to be numbered.
    """

    rows = pick(documents, "doc_id", "source", "text")
    rows = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    rows = materialize(rows)
    rows = rows.withColumn("twin", F.lit(0).cast("long")) if unique else materialize(number_twins(rows))
    targets = materialize(source_targets(rows, schedules, demand, float(most_passes)))
    placed = materialize(join_table(place(rows), targets, ["source"]))
    copies = F.size(F.filter(F.sequence(F.lit(0), F.lit(most_passes - 1)), lambda p: p * F.col("source_size") + F.col("start") + F.col("size") <= F.col("target")))
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)))
    placed = materialize(placed)
    gaps, extra = fill(placed, most_passes)
    own = placed.limit(0).select("source", "start", "size", F.lit(0.0).alias("at"))
    for t in extra:
        own = own.union(t)
    own = own.groupBy("source", "start").agg(F.sort_array(F.collect_list("at")).alias("further"))
    none = F.array().cast("array<double>")
    filled = join_table(placed, materialize(own), ["source", "start"], "left") if extra else placed.withColumn("further", none)
    filled = filled.withColumn("further", F.when((F.col("size") > 0) & F.col("further").isNotNull(), F.col("further")).otherwise(none))
    filled = materialize(filled)
    # the document that may be taken once more and whose size is nearest to what is still missing
    near = join_table(filled, gaps.select("source", "gap"), ["source"])
    near = near.where((F.col("size") > 0) & (F.col("copies") + F.size("further") < most_passes) & (F.col("size") < 2 * F.col("gap")))
    best = near.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("start").alias("last"), F.col("size").alias("last_size"))).alias("best"))
    best = join_table(gaps.select("source", "gap"), best.select("source", "best.last", "best.last_size"), ["source"], "left")
    out = join_table(filled, best, ["source"], "left")
    closes = F.coalesce((F.col("size") > 0) & (F.col("start") == F.col("last")), F.lit(False))
    taken_all = F.col("target") - F.col("gap") + F.coalesce("last_size", F.lit(0))
    out = out.withColumn("demand", F.greatest(taken_all, F.col("target")))
    out = out.withColumn("further", F.when(closes, F.concat("further", F.array(F.col("target") - F.col("gap")))).otherwise(F.col("further")))
    begin = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda p: (p * F.col("source_size") + F.col("start")).cast("double"))).otherwise(none)
    out = out.withColumn("begin", F.concat(begin, "further")).withColumn("copies", F.size("begin"))
    share = lambda x: F.least((x + F.col("size") / 2) / F.col("demand"), F.lit(1.0))
    positions = F.transform("begin", lambda x: position(F.col("knots"), share(x)))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"), positions.alias("positions"), "h")


def positions(plan: DataFrame) -> DataFrame:
    """The taken copies of a plan: doc_id, source, size, h, copy, position."""
    return plan.select("doc_id", "source", "size", "h", F.posexplode("positions").alias("copy", "position"))


def in_order(rows: DataFrame, by: str, ties: list[str]) -> DataFrame:
    """rows sorted in ranges by a training position (0 to 1; greater ones come last).

    Training time is demand, which the schedules spread evenly but for a small factor, so its
    ranges are cells of equal width: no sample of the rows has to be taken first, which would
    run their plan twice.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = F.least(F.floor(F.col(by) * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, cell).sortWithinPartitions(by, *ties)


def curriculum(plan: DataFrame) -> DataFrame:
    """positions() sorted in ranges by training position."""
    return in_order(positions(plan), "position", ["h", "doc_id", "copy"]).drop("h")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each, in the order of first use in training."""
    with scratch(spark) as keep:
        plan = plan_mixture(load(spark, sf_dir, "documents")).drop("source")
        plan = keep(materialize(plan.withColumn("first_position", F.array_min("positions")).drop("positions")))
    taken, rest = plan.where(F.col("copies") > 0), plan.where(F.col("copies") == 0)
    # documents that the mix doesn't take have no place in training and stay where they are
    rows = in_order(taken, "first_position", ["h", "doc_id"]).unionByName(rest)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "first_position")
