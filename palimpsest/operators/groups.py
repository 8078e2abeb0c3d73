"""Items in order, put into groups of bounded size, one after another, without a row or task that holds a key.

A group takes the next items as long as they fit, and a larger item is a group of its own. Where a
group ends depends on where it starts, and so on from the first item of its key: a chain through all
of them. Running sums make each link a threshold: the group that starts at an item goes on to the
first item whose running sum exceeds it. Keys are cut into chunks of items; each chunk tells, for
every threshold that may come in, which goes out and how many groups start between (few different
ones, as chains that start apart soon meet); the chunks of a key are folded; then every chunk knows
the threshold that comes in, and numbers its groups by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.working import kept

#: Items of a chunk, and a threshold that every running sum exceeds.
CHUNK, LOWEST = 4096, -(1 << 62)


def running(rows: DataFrame, by: str, order: list[str], size: str) -> DataFrame:
    """rows with place (from 0) and upto (the sum of size so far) within each key, in order: ranges of rows are summed
    apart, and each adds the sums of its key in the ranges before."""
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = kept(rows.repartitionByRange(n, F.col(by), *order).withColumn("__part", F.spark_partition_id()))
    sums = part.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__s"))
    before = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(by).alias("__by"), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"), F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"))
    here = Window.partitionBy(by, "__part").orderBy(*order)
    told = part.withColumn("__i", F.row_number().over(here) - 1).withColumn("__u", F.sum(size).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    told = told.join(sums, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__part") == F.col("__at")))
    out = told.withColumn("place", (F.col("__i") + F.col("__n")).cast("long")).withColumn("upto", (F.col("__u") + F.col("__s")).cast("long"))
    return out.drop("__part", "__by", "__at", "__n", "__s", "__i", "__u")


def _chunks(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Chunks of rows in order: key, chunk, running sums, thresholds, places, and what all rows of the chunk say of more."""
    key, held, said = None, [], ()
    for batch in batches:
        k, chunk = batch.column("k").to_numpy(), batch.column("chunk").to_numpy()
        columns = [batch.column(c).to_numpy() for c in ("upto", "limit", "place")]
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]) | (chunk[1:] != chunk[:-1])) + 1).tolist(), len(k)]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            mine = (int(k[start]), int(chunk[start]))
            if mine != key:
                if held:
                    yield *key, *map(np.concatenate, zip(*held)), *said
                key, held, said = mine, [], tuple(batch.column(c)[start].as_py() for c in more)
            held.append([c[start:end] for c in columns])
    if held:
        yield *key, *map(np.concatenate, zip(*held)), *said


def _links(upto: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups that start at each item: the threshold that leaves the chunk, and the groups up to there."""
    after = np.searchsorted(upto, limit, side="right")
    out, n = limit.copy(), np.ones(len(upto), dtype=np.int64)
    for i in range(len(upto) - 1, -1, -1):
        if after[i] < len(upto):
            out[i], n[i] = out[after[i]], n[after[i]] + 1
    return out, n


_TOLD = pa.schema([("k", pa.int64()), ("chunk", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("below", "out", "n")]])


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk as runs: thresholds below `below` (and at least the run's before) leave as `out` after n groups."""
    told = []
    for k, chunk, upto, limit, _ in _chunks(batches):
        out, n = _links(upto, limit)
        ends = np.flatnonzero(np.append((out[1:] != out[:-1]) | (n[1:] != n[:-1]), True))
        told.append({"k": k, "chunk": chunk, "below": upto[ends].tolist(), "out": out[ends].tolist(), "n": n[ends].tolist()})
        if len(told) == 1024:
            yield pa.RecordBatch.from_pylist(told, schema=_TOLD)
            told = []
    if told:
        yield pa.RecordBatch.from_pylist(told, schema=_TOLD)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a key in order: the threshold that comes into each, and the groups that started before it."""
    key, threshold, groups = None, LOWEST, 0
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if (r["k"],) != key:
                key, threshold, groups = (r["k"],), LOWEST, 0
            rows.append({"k": r["k"], "chunk": r["chunk"], "threshold": threshold, "groups": groups})
            run = next((i for i, x in enumerate(r["below"]) if x > threshold), None)
            if run is not None:
                threshold, groups = r["out"][run], groups + r["n"][run]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.int64()) for c in ("k", "chunk", "threshold", "groups")]))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chunks, with what comes in, to the number of each item's group."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["k", "place", "group"])

    for k, _, upto, limit, places, threshold, groups in _chunks(batches, "threshold", "groups"):
        starts, at = np.zeros(len(upto), dtype=np.int64), int(np.searchsorted(upto, threshold, side="right"))
        while at < len(upto):
            starts[at] = 1
            at = int(np.searchsorted(upto, limit[at], side="right"))
        held.append((np.full(len(places), k, dtype=np.int64), places, groups - 1 + np.cumsum(starts)))
        n += len(places)
        if n >= 65_536:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def grouped(items: DataFrame, by: str, order: list[str], size: str, most: int, block: str | None = None, header: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Items (by, order..., size, and maybe block and header) with group, the number (from 0) of their group within the
    key: groups of consecutive items of at most ``most`` in size, a larger item alone in its group.

    Where a group's items of one block follow each other, the size of the block's header is counted once, before the
    first of them. Items of size 0 or less count as 1. Null is a key like others.
    """
    rows = items.withColumn("__size", F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(1)), F.lit(1).cast("long")))
    # keys as whole numbers, so that every type of key goes one way
    keys = kept(rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n")).select(by, F.xxhash64(F.col(by), F.col(by).isNull()).alias("__k")))
    rows = rows.join(keys.withColumnRenamed(by, "__by"), F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
    if block is not None:
        # the first item of a stretch of one block brings the header: what follows it in order is looked up by place
        rows = running(rows, "__k", order, "__size").drop("upto").withColumnRenamed("place", "__place")
        last = rows.select(F.col("__k").alias("__pk"), (F.col("__place") + 1).alias("__pp"), F.col(block).alias("__before"))
        rows = rows.join(last, (F.col("__k") == F.col("__pk")) & (F.col("__place") == F.col("__pp")), "left").drop("__pp")
        fresh = F.col("__pk").isNull() | ~F.col(block).eqNullSafe(F.col("__before"))
        rows = rows.withColumn("__whole", F.col("__size") + F.when(fresh, F.col(header)).otherwise(0)).withColumn("__extra", F.when(fresh, 0).otherwise(F.col(header)).cast("long")).drop("__pk", "__before")
        order = ["__place"]
    else:
        rows = rows.withColumn("__whole", F.col("__size")).withColumn("__extra", F.lit(0).cast("long"))
    summed = running(rows, "__k", order, "__whole")
    # the sum that a group may reach which starts here; an item that doesn't fit alone ends its group
    limit = F.greatest(F.col("upto") - F.col("__whole") + most - F.col("__extra"), F.col("upto"))
    summed = kept(summed.withColumn("limit", limit).withColumn("chunk", F.floor(F.col("place") / chunk).cast("long")))
    return chained(summed, chunk).select(*items.columns, "group")


def chained(summed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (__k, place, upto, limit: whole numbers, upto rising with place, chunk), with group: the chain starts at a key's
    first row, and from each start goes on to the first row whose upto exceeds the start's limit."""
    links = summed.select(F.col("__k").alias("k"), "chunk", "upto", "limit", "place").repartition("k", "chunk").sortWithinPartitions("k", "chunk", "place")
    told = kept(links.mapInArrow(_tell, "k long, chunk long, below array<long>, out array<long>, n array<long>"))
    entry = kept(told.repartition("k").sortWithinPartitions("k", "chunk").mapInArrow(_fold, "k long, chunk long, threshold long, groups long"))
    numbered = links.join(entry, ["k", "chunk"]).repartition("k", "chunk").sortWithinPartitions("k", "chunk", "place").mapInArrow(_number, "k long, place long, group long")
    return summed.join(numbered.withColumnsRenamed({"k": "__nk", "place": "__np"}), (F.col("__k") == F.col("__nk")) & (F.col("place") == F.col("__np"))).drop("__nk", "__np")
