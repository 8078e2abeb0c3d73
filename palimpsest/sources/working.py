"""Working tables: intermediate results that several parts of a query read, written once.

They go to the folder that all executors share, spark.checkpoint.dir. Only where the session names
none is one set: a temporary folder in local mode (as in tests), else one in the warehouse. They
are deleted when the process ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="palimpsest-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/palimpsest-working-tables"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df, written to a working table and read from it: what follows starts from there, also after a lost executor."""
    spark = df.sparkSession
    path = f"{folder(spark)}/palimpsest-kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
