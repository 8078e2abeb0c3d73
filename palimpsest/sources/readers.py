"""Readers for files whose schemas drift, texts, JSON-lines shards and lookups."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def months(first: str, last: str) -> list[str]:
    """Months from first to last (yyyy-MM), both included."""
    y, m = map(int, first.split("-"))
    out = []
    while f"{y:04d}-{m:02d}" <= last:
        out.append(f"{y:04d}-{m:02d}")
        y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    return out


def file_columns(spark: SparkSession, path: str) -> DataFrame:
    """Columns of one Parquet file as Spark sees them, in order: pos, name, type."""
    fields = spark.read.parquet(path).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(fields)], "pos int, name string, type string")


def footer_columns(path: str) -> list[tuple[str, str]]:
    """Columns of a local Parquet file with their Arrow types, from the footer alone."""
    import pyarrow.parquet as pq

    return [(f.name, str(f.type)) for f in pq.read_schema(path)]


def footer_stats(path: str, column: str) -> dict:
    """Least and greatest value, nulls and rows of a column from the row groups' statistics; None where a group has none."""
    import pyarrow.parquet as pq

    meta = pq.ParquetFile(path).metadata
    at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}[column]
    groups = [meta.row_group(g).column(at).statistics for g in range(meta.num_row_groups)]
    if any(s is None or not s.has_min_max for s in groups):
        return {"min": None, "max": None, "null_count": None, "n_rows": meta.num_rows}
    return {"min": min(s.min for s in groups), "max": max(s.max for s in groups), "null_count": sum(s.null_count for s in groups), "n_rows": meta.num_rows}


def read_drifting(spark: SparkSession, paths: list[str], concepts: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Files with different schemas as one table. concepts: name -> (type, candidate columns).

    Files with equal schemas are read in one scan; each scan is projected to the concepts (the
    first candidate that exists, in any case; null of the type if none) and cast, so that a
    column may change name, case, presence and type between files.
    """
    groups = defaultdict(list)
    for p in paths:
        groups[tuple((f.name, f.dataType.simpleString()) for f in spark.read.parquet(p).schema.fields)].append(p)
    out = None
    for schema, group in groups.items():
        rows = spark.read.parquet(*group)
        lower = {}
        for name, _ in schema:
            lower.setdefault(name.lower(), name)
        columns = []
        for concept, (kind, candidates) in concepts.items():
            name = next((lower[c.lower()] for c in candidates if c.lower() in lower), None)
            columns.append((F.col(f"`{name}`").try_cast(kind) if name else F.lit(None).cast(kind)).alias(concept))
        part = rows.select(*columns, F.col("_metadata.file_name").alias("file"))
        out = part if out is None else out.unionByName(part)
    return out


def read_csv_text(spark: SparkSession, paths: list[str]) -> DataFrame:
    """CSV files with headers, every column as text; files with different headers are united by name."""
    groups = defaultdict(list)
    for p in paths:
        groups[tuple(spark.read.option("header", True).csv(p).columns)].append(p)
    out = None
    for group in groups.values():
        part = spark.read.option("header", True).csv(group)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with line ends as \\n: path, text."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return rows.select("path", F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_shards(spark: SparkSession, paths: list[str], schema: str, keys: list[str]) -> DataFrame:
    """JSON-lines shards in the given order: bad lines are skipped and a key's first record wins."""
    order = F.array_position(F.array(*[F.lit(p.rsplit("/", 1)[-1]) for p in paths]), F.col("_metadata.file_name"))
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths).withColumn("__f", order).withColumn("__b", F.col("_metadata.file_block_start")).withColumn("__r", F.monotonically_increasing_id())
    rows = rows.where(F.col(keys[0]).isNotNull())
    w = Window.partitionBy(*keys).orderBy("__f", "__b", "__r")  # a split of a shard is read in order by one task
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__f", "__b", "__r", "__n")


def read_lookup(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A lookup table's rows with a whole-number key."""
    return rows.where(F.col(key).rlike(r"^\d+$")).select(F.col(key).cast("long").alias(key), *columns)


def first_versions(docs: DataFrame) -> DataFrame:
    """docs (path, arrival, text): of versions of a path that differ in white space alone, the first to arrive."""
    norm = F.md5(F.trim(F.regexp_replace("text", r"\s+", " ")))
    w = Window.partitionBy("path", "__n").orderBy("arrival")
    return docs.withColumn("__n", norm).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__n", "__r")


def footers(spark: SparkSession, path: str, column: str) -> DataFrame:
    """One row for a Parquet file or folder from its footers alone, read through Spark's file system: n_rows,
    n_groups, codec, created_by, and least and greatest value, nulls of a column (null where a group has no
    statistics). Footers are small and few: a folder has one a part."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    status = fs.getFileStatus(root)
    parts = [x for x in fs.listStatus(root) if x.getPath().getName().endswith(".parquet")] if status.isDirectory() else [status]
    n = groups = nulls = 0
    lows, highs, codecs, makers, known = [], [], set(), set(), True
    for part in parts:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromStatus(part, conf))
        meta = reader.getFooter()
        makers.add(meta.getFileMetaData().getCreatedBy())
        for block in meta.getBlocks():
            n, groups = n + block.getRowCount(), groups + 1
            for chunk in block.getColumns():
                if chunk.getPath().toDotString() != column:
                    continue
                codecs.add(chunk.getCodec().name())
                s = chunk.getStatistics()
                known = known and s.hasNonNullValue() and s.getNumNulls() >= 0
                if known:
                    nulls += s.getNumNulls()
                    lows.append(s.genericGetMin())
                    highs.append(s.genericGetMax())
        reader.close()
    text = lambda x: x if x is None or isinstance(x, (int, float, str)) else x.toStringUsingUTF8()
    lo, hi = (str(min(map(text, lows))), str(max(map(text, highs)))) if known and lows else (None, None)
    row = (n, groups, ",".join(sorted(codecs)), ",".join(sorted(filter(None, makers))), lo, hi, nulls if known else None)
    return spark.createDataFrame([row], "n_rows long, n_groups long, codec string, created_by string, lo string, hi string, nulls long")


def read_zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV members of zip archives as rows of the schema, with archive and member: any newline convention, columns by
    the header's names (null if absent), resource forks and folders skipped. An archive is read by one task, member by
    member and line by line; archives are the unit of work."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    fields = spark.createDataFrame([], schema).schema
    out = ", ".join(["archive string", "member string", *(f"`{f.name}` string" for f in fields)])
    names = [f.name for f in fields]

    def run(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if not member.endswith(".csv") or "__MACOSX" in member or member.rsplit("/", 1)[-1].startswith("._"):
                            continue
                        text = io.TextIOWrapper(z.open(member), "utf-8", "replace", newline=None)
                        rows = csv.DictReader(text)
                        while part := [r for _, r in zip(range(10_000), rows)]:
                            cols = [[r.get(n) or None for r in part] for n in names]
                            arrays = [pa.array([archive] * len(part)), pa.array([member] * len(part)), *(pa.array(c, pa.string()) for c in cols)]
                            yield pa.RecordBatch.from_arrays(arrays, names=["archive", "member", *names])

    rows = files.mapInArrow(run, out)
    return rows.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in fields])


def first_captures(docs: DataFrame) -> DataFrame:
    """docs (path, arrival, text) with arrival a time: of each path and year, the first capture."""
    year = F.year("arrival")
    return docs.groupBy("path", year.alias("year")).agg(F.min("arrival").alias("arrival"), F.min_by("text", "arrival").alias("text"))
