"""Maintenance policies over a version axis, as per-key state.

Inputs are long tables by key (iid) and read (t): truth (the answer that holds), state (the
fingerprint of the evidence) and tokens (what a re-derivation costs). Policies whose state is
a window of the past stay windows; the ones that depend on their own earlier actions stream
through in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.operators import groups
from palimpsest.sources.working import kept


def schedule(versions: DataFrame, kind: str, t: str = "t") -> DataFrame:
    """The reads of a schedule: "every", or "every<k>"."""
    k = int(kind.removeprefix("every") or 1)
    return versions.where(F.col(t) % k == 0)


def bursty(last: int, seed: int = 7, burst: int = 5, gap: int = 30) -> list[int]:
    """Read times in bursts, from a seeded generator."""
    import random

    rng, t, out = random.Random(seed), 0, []
    while t < last:
        t += rng.randint(1, gap)
        for _ in range(rng.randint(1, burst)):
            if t <= last:
                out.append(t)
            t += 1
    return out


def served_at(rows: DataFrame, derived: Column, by: str = "iid", t: str = "t") -> DataFrame:
    """Serve at each read the truth of the latest read at which a policy derived anew (the first one always does)."""
    w = Window.partitionBy(by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("derived", derived | (F.row_number().over(Window.partitionBy(by).orderBy(t)) == 1))
    served = F.last(F.when(F.col("derived"), F.struct(F.col("truth").alias("v"))), ignorenulls=True).over(w)
    return rows.withColumn("served", served["v"]).withColumn("wrong", ~F.col("served").eqNullSafe(F.col("truth")))


def never(rows: DataFrame) -> DataFrame:
    return served_at(rows, F.lit(False))


def always(rows: DataFrame) -> DataFrame:
    return served_at(rows, F.lit(True))


def ttl_epoch(rows: DataFrame, k: int) -> DataFrame:
    """Derive at the first read of each epoch of k versions."""
    w = Window.partitionBy("iid").orderBy("t")
    epoch = F.floor(F.col("t") / k)
    return served_at(rows.withColumn("e", epoch).withColumn("e0", F.lag("e").over(w)), ~F.col("e").eqNullSafe(F.col("e0"))).drop("e", "e0")


def _expiries(k: int):
    """Of reads sorted by key and time, those that derive; a key's clock is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, due = (), 0
        for batch in batches:
            t = batch.column("t").to_numpy()
            codes = batch.column("iid").dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(t)]
            found = []
            for at, end in zip(cuts, cuts[1:]):
                if at == end:
                    continue
                iid = batch.column("iid")[at].as_py()
                if (iid,) != key:
                    key, due = (iid,), int(t[at])
                while (at := at + int(np.searchsorted(t[at:end], due))) < end:
                    found.append(at)
                    due = int(t[at]) + k
            yield batch.take(pa.array(found, pa.int64()))

    return run


def ttl_age_reads(rows: DataFrame, k: int) -> DataFrame:
    """Per key, the reads at which an answer at least k versions old is derived anew; its clock restarts at
    that read. Sorted reads stream through in batches, and each due read is searched for from the one
    before, so nothing holds a key. Reads without a time are none; several at one time are one."""
    reads = rows.select("iid", F.col("t").cast("long").alias("t")).where("t is not null").repartition("iid").sortWithinPartitions("iid", "t")
    return reads.mapInArrow(_expiries(k), reads.schema)


def ttl_age(rows: DataFrame, k: int) -> DataFrame:
    due = ttl_age_reads(rows, k).select(F.col("iid").alias("__iid"), F.col("t").alias("__t"))
    told = rows.join(due, F.col("iid").eqNullSafe(F.col("__iid")) & (F.col("t") == F.col("__t")), "left")
    return served_at(told, F.col("__t").isNotNull()).drop("__iid", "__t")


def guard(rows: DataFrame, state: str = "state") -> DataFrame:
    """Replay, file-hash or manifest guards: derive anew whenever the state differs from the last read's."""
    before = F.lag(state).over(Window.partitionBy("iid").orderBy("t"))
    return served_at(rows.withColumn("s0", before), ~F.col(state).eqNullSafe(F.col("s0"))).drop("s0")


def detect(rows: DataFrame) -> DataFrame:
    """Detection with evidence fixed at the first read: same, eval (a new state) or memo (one seen before)."""
    w = Window.partitionBy("iid").orderBy("t")
    first = F.first("state").over(w)
    again = F.row_number().over(Window.partitionBy("iid", "state").orderBy("t")) > 1
    return rows.withColumn("action", F.when(F.col("state").eqNullSafe(first), "same").when(again, "memo").otherwise("eval"))


def _machine(force_after: int, unsure: str, schema: pa.Schema):
    """The verdict-driven machine over reads sorted by key and time. What it remembers of a key is the answer served, its
    evidence and time, and the states judged valid since; nothing of a key's reads is held beyond a batch."""
    keeps = ("still_valid", "unsure") if unsure == "fresh" else ("still_valid",)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, served, anchor, since, memo = (), None, None, None, set()
        for batch in batches:
            out = []
            for iid, t, truth, state, verdict, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if (iid,) != key:
                    key, served, anchor, since, memo = (iid,), None, None, None, set()
                asked = False
                if since is None:
                    action = "derive"
                elif force_after and t is not None and t - since >= force_after:
                    action = "forced"
                elif state == anchor:
                    action = "same"
                elif (state or "") in memo:
                    action = "memo"
                else:
                    asked = True
                    action = ("valid" if verdict == "still_valid" else "unsure_fresh") if verdict in keeps else "repair" if verdict == "changed" else "rederive"
                if anew := action in ("derive", "forced", "repair", "rederive"):
                    served, anchor, since, memo = truth, state, t, set()
                elif asked:
                    memo.add(state or "")
                told = None if tokens is None else tokens // 10
                out.append((iid, t, action, served, served != truth, told if asked else 0, tokens if anew else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def verdict_driven(rows: DataFrame, force_after: int = 0, unsure: str = "rederive") -> DataFrame:
    """The evidence-state policy: equal evidence serves the stored answer; a new state asks for a verdict,
    remembers a valid one, and repairs or derives anew otherwise, which re-anchors the evidence.

    Its query set depends on its own actions, so a key's reads are gone through in order: they are sorted by
    Spark and stream through a worker in batches, in time proportional to their number. Reads of one
    time are ordered by their other columns; a null verdict derives anew; a null state equals a null state.
    """
    columns = ["iid", F.col("t").cast("long").alias("t"), F.col("truth").cast("string").alias("truth"), F.col("state").cast("string").alias("state"), F.col("verdict").cast("string").alias("verdict"), F.col("tokens").cast("long").alias("tokens")]
    reads = rows.select(*columns).repartition("iid").sortWithinPartitions("iid", "t", "truth", "state", "verdict", "tokens")
    kind = StructType([rows.schema["iid"], *StructType.fromDDL("t long, action string, served string, wrong boolean, eval_tok long, der_tok long")])
    return reads.mapInArrow(_machine(force_after, unsure, to_arrow_schema(kind)), kind)


def at_times(rows: DataFrame, times: list[int], t: str = "t") -> DataFrame:
    """The reads at given times: a schedule, as long as the version axis."""
    return rows.where(F.col(t).isin(times))


def sweep(rows: DataFrame, ages: list[int], schedules: list[int]) -> DataFrame:
    """Expiry by age at each read, for several ages and read schedules at once: k, every, n_reads, n_wrong, n_derived.
    The configuration is a column, so all run in one job."""
    rows = rows.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ages])))
    first = F.first("t").over(Window.partitionBy("k", "iid").orderBy("t"))
    rows = rows.withColumn("derived", (F.col("t") - first) % F.col("k") == 0)
    w = Window.partitionBy("k", "iid").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    served = F.last(F.when(F.col("derived"), F.col("truth")), ignorenulls=True).over(w)
    rows = rows.withColumn("wrong", ~served.eqNullSafe(F.col("truth"))).withColumn("every", F.explode(F.array(*[F.lit(e).cast("long") for e in schedules])))
    return rows.where(F.col("t") % F.col("every") == 0).groupBy("k", "every").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if("wrong").alias("n_wrong"), F.count_if("derived").alias("n_derived"))


#: Named policies: each takes reads (iid, t, truth, state) and gives them with derived, served and wrong.
REGISTRY = {"never": never, "always": always, "replay": guard, "filehash": guard, "manifest": guard}


def run(name: str, rows: DataFrame) -> DataFrame:
    """A policy by name: one of REGISTRY, or ttl_epoch<k> or ttl_age<k>."""
    for prefix, f in (("ttl_epoch", ttl_epoch), ("ttl_age", ttl_age)):
        if name.startswith(prefix) and name.removeprefix(prefix).isdigit():
            return f(rows, int(name.removeprefix(prefix)))
    if name not in REGISTRY:
        raise KeyError(f"no policy is called {name!r}")
    return REGISTRY[name](rows)


def configured(reads: DataFrame, triggers: DataFrame, configurations: DataFrame, chunk: int = groups.CHUNK) -> DataFrame:
    """Many configurations of one policy in one pass: config, iid, n_reads, n_derived, n_wrong.

    reads: iid, t (whole numbers, in any spacing), truth; triggers: iid, t; configurations, a short table: config,
    every (only reads whose place in their key divides by it), age (a derivation expires after so much t; null: never),
    triggered (whether a trigger, too, makes the next read derive; it is carried forward to that read).

    A read of a configuration derives where its last derivation has expired or a trigger fired since the read
    before. A trigger cuts a key's reads into stretches that start with a derivation; within one, derivations are a
    chain by age, which goes through all reads of all configurations in chunks: no fold holds a key.
    """
    place = F.row_number().over(Window.partitionBy("iid").orderBy("t")) - 1
    # how many triggers fired up to each read: a union in order of time, triggers first
    marks = reads.select("iid", "t", "truth", F.lit(0).alias("fired"), F.lit(1).alias("read")).unionByName(triggers.select("iid", "t", F.lit(None).cast(reads.schema["truth"].dataType).alias("truth"), F.lit(1).alias("fired"), F.lit(0).alias("read")))
    upto = F.sum("fired").over(Window.partitionBy("iid").orderBy("t", "read").rowsBetween(Window.unboundedPreceding, 0))
    told = marks.withColumn("stretch", upto).where("read = 1").withColumn("at", place)
    rows = told.crossJoin(F.broadcast(configurations)).where(F.col("at") % F.col("every") == 0)  # a short table, by contract
    rows = rows.withColumn("stretch", F.when(F.col("triggered"), F.col("stretch")).otherwise(0))
    rows = rows.withColumn("__k", F.xxhash64("config", "iid", "stretch"))
    order = Window.partitionBy("__k").orderBy("t")
    never = F.lit(1 << 61)
    summed = rows.withColumn("place", (F.row_number().over(order) - 1).cast("long")).withColumn("upto", F.col("t").cast("long"))
    summed = kept(summed.withColumn("limit", F.coalesce(F.col("upto") + F.col("age") - 1, never).cast("long")).withColumn("chunk", F.floor(F.col("place") / chunk).cast("long")))
    grouped = groups.chained(summed, chunk)
    served = F.first("truth").over(Window.partitionBy("__k", "group").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    start = F.row_number().over(Window.partitionBy("__k", "group").orderBy("t")) == 1
    out = grouped.withColumn("derived", start).withColumn("wrong", ~served.eqNullSafe(F.col("truth")))
    return out.groupBy("config", "iid").agg(F.count(F.lit(1)).alias("n_reads"), F.count_if("derived").alias("n_derived"), F.count_if("wrong").alias("n_wrong"))
