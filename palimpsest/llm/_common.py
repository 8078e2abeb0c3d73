"""Helpers shared by the training-data operators: tables kept in shared storage,
joins guarded by a size check, and a rank over a whole table without a single task."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Most rows of a table that may be broadcast, and most bytes of its strings, arrays and binary
#: values; both are checked first. The driver holds each such table more than once, and several at a time.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8_000_000

#: Rows that go to a Python worker at once; texts may be long.
BATCH_ROWS = 1000

#: Tables that are still there, and, innermost last, the scopes that own those written in them.
_written: list[str] = []
_scopes = threading.local()
_exits: list = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where the session has none is one set: a temporary folder where everything runs on
    this machine (as in tests), else one in the warehouse, which a cluster shares.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/palimpsest-working-tables"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs at most the tasks that ran on it,
    and columns made by monotonically_increasing_id() or by a sample of ranges
    no longer change when a task runs again. The table belongs to the innermost scratch()
    of the calling thread; without one it stays until it is released or the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest-{uuid.uuid4().hex}"
    owners = getattr(_scopes, "open", [])
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    if not _exits:
        _exits.append(atexit.register(lambda: delete(spark, list(_written))))
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.palimpsest_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Owns the tables that materialize() writes inside, and deletes them at its end.

    It gives a function that hands a table over to the scope around (or, without one, to the
    caller): that table stays. Scopes know only their own tables, so two results that are held
    at once never lose theirs.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    mine: list[str] = []

    def keep(table: DataFrame) -> DataFrame:
        mine.remove(table.palimpsest_path)
        at = next(i for i, x in enumerate(_scopes.open) if x is mine)
        if at:
            _scopes.open[at - 1].append(table.palimpsest_path)
        return table

    _scopes.open.append(mine)
    try:
        yield keep
    finally:
        _scopes.open = [x for x in _scopes.open if x is not mine]
        delete(spark, mine)


def written() -> set[str]:
    """The tables that materialize() has written and nobody has deleted."""
    return set(_written)


def delete(spark: SparkSession, paths) -> None:
    """Remove tables of materialize(); whatever still reads them must have run."""
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in _written:
            _written.remove(p)


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, [t.palimpsest_path])


def _held(value: Column, kind: DataType) -> Column:
    """Bytes of a value of varying length, in structs as well; others count nothing."""
    name = kind.typeName()
    if name in ("string", "binary"):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if name in ("array", "map"):
        return F.coalesce(8 * F.greatest(F.size(value), F.lit(0)), F.lit(0)).cast("long")
    if name == "struct":
        return reduce(add, [_held(value.getField(f.name), f.dataType) for f in kind], F.lit(0).cast("long"))
    return F.lit(0).cast("long")


def small(table: DataFrame, rows: int | None = None) -> bool:
    """Whether a table may be broadcast: its rows (BROADCAST_ROWS at most, or as told), and the bytes of
    its columns of varying length, are few."""
    rows = BROADCAST_ROWS if rows is None else rows
    size = reduce(add, [_held(F.col(f"`{f.name}`"), f.dataType) for f in table.schema], F.lit(0).cast("long"))
    n, held = table.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(size)).first()
    return n <= rows and (held or 0) <= BROADCAST_BYTES


def join_table(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = 32, known_small: bool | None = None) -> DataFrame:
    """Join rows to a table with one row per key; a key may hold most of the rows.

    Keys compare null-safe. A table that is small() is broadcast (known_small: its caller has looked).
    A larger one is joined by key and salt: its rows are repeated once for each
    salt, so that the rows of one key spread over as many partitions.
    """
    renamed = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & rows[k].eqNullSafe(renamed[f"__{k}"])
    drop = [f"__{k}" for k in keys]
    if small(table) if known_small is None else known_small:
        return rows.join(F.broadcast(renamed), on, how).drop(*drop)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    renamed = renamed.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return salted.join(renamed, on & (salted["__salt"] == renamed["__salt2"]), how).drop("__salt", "__salt2", *drop)


def global_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the position (long, from 0) of each row in the order of the whole table.

    Rows are dealt out by range; ranks are row numbers within a range plus the
    rows of the ranges before, so no task sees all rows.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    before = part.groupBy("__part").count().withColumn("__before", F.sum("count").over(Window.orderBy("__part")) - F.col("count")).drop("count")
    here = part.withColumn(name, (F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1).cast("long"))
    return here.join(F.broadcast(before), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns can't clash with an operator's own.

    It also sees to it that the session sends rows to Python workers in batches of at most BATCH_ROWS.
    """
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df.select(*[F.col(f"`{n}`") for n in names])


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8_000_000) -> Iterator[tuple[int, list]]:
    """A text column of a batch in runs of bounded length: (first row, texts as bytes, null as None)."""
    values = batch.column(column).cast(pa.large_binary())
    start, run, held = 0, [], 0
    for i in range(len(values)):
        v = values[i].as_py()
        run.append(v)
        held += len(v or b"")
        if held >= most_bytes:
            yield start, run
            start, run, held = i + 1, [], 0
    if run:
        yield start, run
