"""Exact top-k search by distributed histogram selection.

Vectors become integers (floor(256 * x)) and are packed into blocks. Every query block
meets every candidate block; all pairs are scored by a matrix product. For each query,
a global histogram of its scores, refined inside one bin round after round, locates the
k-th greatest score: until the bin is one value wide, or so few scores are at or above
it that they can simply be ranked. A round narrows the range 256 times, so that eight are
enough for any. The last pass keeps the scores from there on and breaks ties by smaller vec_id.

Blocks meet in a grid of slices of candidates and groups of queries, with about PAIRS scores
in each cell. Candidates are copied once for each group and queries once for each slice; the
grid's sides are chosen so that both copies are about as large. Few queries make one group,
and then candidates aren't copied at all.

A block leaves out the histogram bins below the one that holds its own k-th best score of a
query: nothing in them can be among the global k best. Histograms are summed before they are
shuffled; nothing grows on the driver but one row of progress a round.

Exactness: products are taken in float64 where every partial sum stays below 2**53,
else with unbounded integers; a score outside the range of a long saturates.

Defined cases: null vectors, vectors with null or non-finite components and rows with a
null vec_id take no part; a missing component counts as 0 when lengths differ; each row
is a candidate of its own, even when a vec_id repeats, and a query meets every row but
itself; with k or fewer candidates all are returned; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm._common import load, materialize, pick, scratch

BINS = 256
BLOCK = 2048
#: A query is settled when at most this many times k scores are at or above its bin.
RANKED = 8
#: Scores that one cell of the grid computes about, and bytes of candidates that it holds at most.
PAIRS, SLICE_BYTES = 2**32, 64_000_000
LONG = (-(2**63), 2**63 - 1)


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, vectors = [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
                continue
            scaled = 256.0 * np.asarray(v, dtype=np.float64)
            if len(v) and (not np.isfinite(scaled).all() or np.abs(scaled).max() >= 2**62):
                whole = [max(LONG[0], min(LONG[1], int(math.floor(256 * int(x) if abs(x) >= 2**53 else 256 * x)))) for x in v]
            else:
                whole = np.floor(scaled).astype(np.int64).tolist()
            ids.append(i)
            vectors.append(np.asarray(whole, dtype="<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.binary())], names=["vec_id", "v"])


def quantise(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding) to rows uid, vec_id, v (little-endian 64-bit integers)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInArrow(_quantise, "vec_id long, v binary")
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()))


def _block(part: pa.RecordBatch | pa.Table, columns: list[str]) -> list[pa.Array]:
    """One row: each column as the bytes of an int64 array, and the vectors as one matrix."""
    vectors = [np.frombuffer(x, dtype="<i8") for x in part.column("v").to_pylist()]
    d = max((len(x) for x in vectors), default=0)
    m = np.zeros((len(vectors), d), dtype="<i8")
    for i, x in enumerate(vectors):
        m[i, : len(x)] = x
    most = int(np.abs(m.astype(np.float64)).max()) if m.size else 0
    kind = "<i2" if most < 2**15 else "<i8"
    arrays = [pa.array([np.asarray(part.column(c).to_pylist(), dtype="<i8").tobytes()], pa.binary()) for c in columns]
    return [*arrays, pa.array([d], pa.int32()), pa.array([kind]), pa.array([m.astype(kind).tobytes()], pa.binary())]


PACKED = "d int, kind string, m binary"


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield pa.RecordBatch.from_arrays(_block(batch.slice(at, BLOCK), ["uid", "vec_id"]), names=["uid", "vec_id", "d", "kind", "m"])


def _pack_group(table: pa.Table) -> pa.Table:
    names = ["qb", "uid", "vec_id", "lo", "hi", "d", "kind", "m"]
    return pa.table([table.column("qb").combine_chunks()[:1], *_block(table, ["uid", "vec_id", "lo", "hi"])], names=names)


def _matrix(row: dict, side: str) -> np.ndarray:
    d = row[f"{side}d"]
    n = len(row[f"{side}uid"]) // 8
    return np.frombuffer(row[f"{side}m"], dtype=row[f"{side}kind"]).reshape(n, d)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products (int64, saturated) of all rows of q with all of c."""
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    if d == 0:
        return np.zeros((len(q), len(c)), dtype=np.int64)
    qf, cf = q.astype(np.float64), c.astype(np.float64)
    if np.abs(qf).max(initial=0) * np.abs(cf).max(initial=0) * d < 2**53:
        return (qf @ cf.T).astype(np.int64)
    exact = q.astype(object) @ c.astype(object).T
    return np.clip(exact, *LONG).astype(np.int64)


def _meet(k: int, last: bool):
    """For each pair of blocks: histogram rows (quid, bin, n), or in the last pass the rows to rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = {c: np.frombuffer(row[c], dtype="<i8") for c in ("quid", "qvec_id", "lo", "hi", "cuid", "cvec_id")}
                s = _scores(_matrix(row, "q"), _matrix(row, "c"))
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(len(s)):
                    own = ids["cuid"] != ids["quid"][i]
                    lo, hi = int(ids["lo"][i]), int(ids["hi"][i])
                    mine = s[i]
                    at = np.flatnonzero(own & (mine >= lo)) if last else np.flatnonzero(own & (mine >= lo) & (mine <= hi))
                    if not len(at):
                        continue
                    kth = int(np.partition(mine[at], len(at) - k)[len(at) - k]) if len(at) > k else lo
                    if last:  # only the block's own k best, with all ties
                        at = at[mine[at] >= kth]
                        best = at[np.lexsort((ids["cvec_id"][at], -mine[at].astype(np.float64)))] if abs(int(mine[at].max())) < 2**52 else np.array(sorted(at, key=lambda j: (-int(mine[j]), int(ids["cvec_id"][j]))))
                        for j in best[:k]:
                            out[0].append(int(ids["quid"][i]))
                            out[1].append(int(ids["qvec_id"][i]))
                            out[2].append(int(ids["cvec_id"][j]))
                            out[3].append(int(mine[j]))
                    else:
                        width = max(1, -((lo - hi - 1) // BINS))
                        bins = np.array([(int(x) - lo) // width for x in mine[at]], dtype=np.int64) if hi - lo >= 2**62 else (mine[at] - lo) // width
                        found, n = np.unique(bins[bins >= (kth - lo) // width], return_counts=True)
                        out[0].extend([int(ids["quid"][i])] * len(found))
                        out[1].extend(found.tolist())
                        out[2].extend(n.tolist())
                if last:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["quid", "query_id", "vec_id", "score"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:3]], names=["quid", "bin", "n"])

    return run


def _pairs(queries: DataFrame, blocks: DataFrame, n_rows: int, row_bytes: int) -> DataFrame:
    """Every query block beside every candidate block, by an equi-join on the cells of a grid."""
    n = queries.count()
    tasks = max(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows * n // PAIRS))
    groups = max(1, min(-(-n // BLOCK), round((tasks * n / max(1, n_rows)) ** 0.5)))
    slices = max(1, min(-(-n_rows // BLOCK), -(-tasks // groups)), -(-n_rows * row_bytes // SLICE_BYTES))
    qb = queries.withColumn("qb", F.pmod(F.xxhash64("uid"), F.lit(-(-n // BLOCK) or 1)).cast("int")).groupBy("qb")
    qb = qb.applyInArrow(_pack_group, "qb int, uid binary, vec_id binary, lo binary, hi binary, " + PACKED)
    qb = qb.select((F.col("qb") % groups).alias("group"), F.col("uid").alias("quid"), F.col("vec_id").alias("qvec_id"), "lo", "hi", F.col("d").alias("qd"), F.col("kind").alias("qkind"), F.col("m").alias("qm"))
    qb = qb.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    cb = blocks.withColumn("slice", F.pmod(F.xxhash64("cb"), F.lit(slices)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return qb.join(cb.hint("shuffle_hash"), ["group", "slice"])


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k greatest integer inner products of each query (vec_id divisible by ``every``):
    query_id, rank (int from 1), vec_id, score (long)."""
    with scratch(embeddings.sparkSession) as keep:
        rows = quantise(pick(embeddings, "vec_id", "embedding"))
        blocks = rows.select("uid", "vec_id", "v").mapInArrow(_pack_rows, "uid binary, vec_id binary, " + PACKED)
        blocks = blocks.select(F.col("uid").alias("cuid"), F.col("vec_id").alias("cvec_id"), F.col("d").alias("cd"), F.col("kind").alias("ckind"), F.col("m").alias("cm"))
        blocks = materialize(blocks.withColumn("cb", F.monotonically_increasing_id()))
        n_rows, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("v")), F.lit(0))).first()
        row_bytes = total // max(1, n_rows)
        longest = rows.mapInArrow(_norms, "uid long, norm double")
        most = longest.agg(F.max("norm")).first()[0] or 0.0
        bound = F.least(F.ceil(F.col("norm") * F.lit(most) * 1.0000001) + 1, F.lit(float(2**62))).cast("long")
        state = rows.where(F.pmod("vec_id", F.lit(every)) == 0).join(longest, "uid").select("uid", "vec_id", "v", (-bound).alias("lo"), bound.alias("hi"), F.lit(0).cast("long").alias("above"), F.lit(n_rows - 1 <= k).alias("done"))
        state = materialize(state)
        while True:
            open_ = state.where(~F.col("done"))
            if open_.limit(1).count() == 0:
                break
            hist = _pairs(open_, blocks, n_rows, row_bytes).mapInArrow(_meet(k, False), "quid long, bin long, n long").groupBy("quid", "bin").agg(F.sum("n").alias("n"))
            w = Window.partitionBy("quid").orderBy(F.col("bin").desc())
            hist = hist.withColumn("upto", F.sum("n").over(w)).withColumnRenamed("quid", "uid")
            got = open_.select("uid", "above").join(hist, "uid").where((F.col("above") + F.col("upto") >= k) & (F.col("above") + F.col("upto") - F.col("n") < k))
            got = got.select("uid", "bin", (F.col("above") + F.col("upto")).alias("reach"), (F.col("above") + F.col("upto") - F.col("n")).alias("over"))
            s = state.join(got, "uid", "left")
            width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") + 1).cast("decimal(38,0)") / BINS).cast("long"))
            lo = F.col("lo") + F.col("bin") * width
            hi = F.least(F.col("hi"), lo + width - 1)
            fresh = F.col("bin").isNotNull()
            state = materialize(
                s.select(
                    "uid",
                    "vec_id",
                    "v",
                    F.when(fresh, lo).otherwise(F.col("lo")).alias("lo"),
                    F.when(fresh, hi).otherwise(F.col("hi")).alias("hi"),
                    F.when(fresh, F.col("over")).otherwise(F.col("above")).alias("above"),
                    (F.col("done") | ~fresh | (lo >= hi) | (F.col("reach") <= RANKED * k)).alias("done"),
                )
            )
        keep(blocks), keep(state)
    found = _pairs(state, blocks, n_rows, row_bytes).mapInArrow(_meet(k, True), "quid long, query_id long, vec_id long, score long")
    w = Window.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        norms = [float(np.linalg.norm(np.frombuffer(x, dtype="<i8").astype(np.float64))) for x in batch.column("v").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(norms, pa.float64())], names=["uid", "norm"])


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every query vector over the whole embeddings table."""
    return top_k(load(spark, sf_dir, "embeddings"))


SQL = """
with v as (
  select row_number() over () as place, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.place <> c.place where q.vec_id % 50 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""
