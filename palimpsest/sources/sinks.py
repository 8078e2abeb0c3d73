"""Sinks: content-addressed blobs, and tables that merge by key."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def put_blob(root: str, data: bytes, ext: str = "", spark: SparkSession | None = None) -> tuple[str, int]:
    """Store bytes once under their sha256, by an atomic rename: (sha, size). With a session the folder may be on any
    file system that Spark writes to; without one it is local."""
    sha = hashlib.sha256(data).hexdigest()
    if spark is not None:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{sha[:2]}/{sha}{ext}")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            tmp = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{sha[:2]}/.{uuid.uuid4().hex}")
            out = fs.create(tmp)
            out.write(bytearray(data))
            out.close()
            if not fs.rename(tmp, path):
                fs.delete(tmp, False)
        return sha, len(data)
    path = os.path.join(root, sha[:2], sha + ext)
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        tmp = f"{path}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(data)
        os.replace(tmp, path)
    return sha, len(data)


def verify_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Blobs whose content doesn't match their name: path, sha, size."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_extract("path", r"([0-9a-f]{64})[^/]*$", 1)
    return rows.select("path", F.sha2("content", 256).alias("sha"), F.col("length").alias("size"), name.alias("name")).where("sha <> name").drop("name")


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the keys that stand in new replaced by new's rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def fill_missing(current: DataFrame, extra: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A merge that only fills cells without a value."""
    a = current.select(*keys, F.col(value).alias("__a"))
    b = extra.select(*keys, F.col(value).alias("__b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("__a", "__b").alias(value))


def describe_sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Row counts and schemas of Parquet sources: path (the given name), n_rows, columns."""
    out = None
    for name, path in paths.items():
        rows = spark.read.parquet(path)
        one = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("path"), "n_rows", F.lit(rows.schema.simpleString()).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def verify_sources(catalogue: DataFrame, found: DataFrame) -> DataFrame:
    """Sources found against those that a catalogue knows: ok, rows differ, schema differs, unknown or missing."""
    known = catalogue.select("path", F.col("n_rows").alias("__n"), F.col("columns").alias("__c"))
    verdict = (
        F.when(F.col("__n").isNull(), "unknown")
        .when(F.col("n_rows").isNull(), "missing")
        .when(F.col("n_rows") != F.col("__n"), "rows differ")
        .when(F.col("columns") != F.col("__c"), "schema differs")
        .otherwise("ok")
    )
    return found.join(known, "path", "full_outer").select("path", F.coalesce("n_rows", "__n").alias("n_rows"), verdict.alias("verdict"))


def ingest(spark: SparkSession, source: DataFrame, name: str, target: str, catalogue: str, codec: str = "zstd") -> bool:
    """Write a source as Parquet once: False if the catalogue (a Parquet table: name, n_rows, columns) knows it
    already. The catalogue's row is written after the data, so an ingest that broke off is done again."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(catalogue)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if there and spark.read.parquet(catalogue).where(F.col("name") == name).limit(1).count():
        return False
    source.write.mode("overwrite").option("compression", codec).parquet(f"{target}/{name}")
    n = spark.read.parquet(f"{target}/{name}").count()
    spark.createDataFrame([(name, n, source.schema.simpleString())], "name string, n_rows long, columns string").write.mode("append").parquet(catalogue)
    return True


def request_key(*parts) -> Column:
    """The key of a request in the response cache: sha256 over its parts as JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def cached(requests: DataFrame, cache: DataFrame, default: str = "unsure") -> DataFrame:
    """Requests (key, ...) with the recorded response (key, response) of each, and whether it was a hit; the first
    recorded one wins, a miss gives the default."""
    one = cache.groupBy("key").agg(F.min("response").alias("response"))
    return requests.join(one, "key", "left").withColumn("hit", F.col("response").isNotNull()).withColumn("response", F.coalesce("response", F.lit(default)))


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown: a result of at most ``most`` rows, with a mark if there are more."""
    got = rows.limit(most + 1).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + "---|" * len(rows.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in got[:most])]
    return "\n".join(lines) + ("\n\n(more rows follow)" if len(got) > most else "") + "\n"
