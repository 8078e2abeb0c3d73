"""Exact deduplication by content-defined chunk recipes.

White space runs become one space; the UTF-8 bytes are cut where a rolling hash of the
last 32 bytes has zero low bits (with a least and a greatest chunk length). A document's
recipe is the ordered list of its chunk identifiers, and texts are equal when their
recipes are equal.

Identifiers are verified: the distinct chunk contents below one 64-bit hash are compared
byte by byte (grouping by hash and content, combined on the map side, so each content
leaves a task once). Where one hash has several contents, the documents that hold it
get the content's digest in their recipe instead of the hash. Long documents never
travel: only chunks do, once, for the check.

The kept row of a group is the one with the smallest doc_id (null last); among rows that
repeat the same doc_id and text, one stays. Groups are formed by a combining aggregate
and looked up by a salted join, so a third of all rows may be copies of one text.

Defined cases: a null text is the empty text; an empty table gives no rows; a group whose
doc_ids are all null has a null keep_id; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm._common import join_table, load, materialize, pick, slices

#: Chunk lengths in bytes: no boundary before LEAST, one at MOST at the latest, about AVERAGE between hash boundaries.
LEAST, AVERAGE, MOST = 1024, 4096, 16384
_TABLE = np.random.default_rng(20240607).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: bytes | None) -> bytes:
    """Each run of space and \\x09-\\x0D as one space; null: empty."""
    if not text:
        return b""
    body = b" ".join(text.split())
    ws = b" \t\n\x0b\x0c\r"
    if not body:
        return b" "
    return (b" " if text[0] in ws else b"") + body + (b" " if text[-1] in ws else b"")


def cuts(data: bytes) -> list[int]:
    """End offsets of the content-defined chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _TABLE[np.frombuffer(data, dtype=np.uint8)]
    for step in (1, 2, 4, 8, 16):  # after these, h covers the last 32 bytes
        more = h[step:] + (h[:-step] << np.uint32(step))
        h = np.concatenate([h[:step], more])
    marks = np.flatnonzero((h & np.uint32(AVERAGE - 1)) == 0) + 1
    out, start = [], 0
    for m in marks.tolist():
        while m - start > MOST:
            start += MOST
            out.append(start)
        if m - start >= LEAST and m < n:
            out.append(m)
            start = m
    while n - start > MOST:
        start += MOST
        out.append(start)
    out.append(n)
    return out


def _chunks(text: bytes | None) -> tuple[bytes, list[bytes]]:
    data = normalise(text)
    ends = cuts(data)
    return data, [data[a:b] for a, b in zip([0, *ends], ends)]


def _hash(chunk: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(chunk), "little", signed=True)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in slices(batch, "text"):
            recipes, shas = [], []
            for t in texts:
                data, chunks = _chunks(t)
                recipes.append([_hash(c) for c in chunks])
                shas.append(hashlib.sha256(data).hexdigest())
            ids = batch.column("doc_id").slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([ids, pa.array(recipes, pa.list_(pa.int64())), pa.array(shas, pa.string())], names=["doc_id", "recipe", "text_sha256"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in slices(batch, "text"):
            seen = {}
            for t in texts:
                for c in _chunks(t)[1]:
                    seen.setdefault(c, None)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([_hash(c) for c in keys], pa.int64()), pa.array(keys, pa.binary())], names=["h", "content"])


def _verified(clashes: frozenset[int]):
    """Recipes in which a hash with several contents gives way to digests of the content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in slices(batch, "text"):
                recipes, shas = [], []
                for t in texts:
                    data, chunks = _chunks(t)
                    ids: list[int] = []
                    for c in chunks:
                        h = _hash(c)
                        ids += [h] if h not in clashes else [h, *np.frombuffer(hashlib.sha256(c).digest(), dtype="<i8").tolist()]
                    recipes.append(ids)
                    shas.append(hashlib.sha256(data).hexdigest())
                ids_ = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids_, pa.array(recipes, pa.list_(pa.int64())), pa.array(shas, pa.string())], names=["doc_id", "recipe", "text_sha256"])

    return run


def chunk_table(documents: DataFrame) -> DataFrame:
    """Distinct chunk contents: h, content."""
    return documents.select("text").mapInArrow(_contents, "h long, content binary").groupBy("h", "content").agg(F.lit(1).alias("one")).drop("one")


def exact_groups(documents: DataFrame) -> DataFrame:
    """One row per row of documents: doc_id, keep_id, group_size, kept, text_sha256."""
    docs = pick(documents, "doc_id", "text").withColumn("text", F.col("text").cast("binary"))
    # a chunk hash with two contents is as rare as a 64-bit collision: the list stays a handful of numbers
    clashes = chunk_table(docs).groupBy("h").count().where("count > 1").select("h")
    clashing = frozenset(r[0] for r in clashes.toLocalIterator())
    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, recipe array<long>, text_sha256 string"
    rows = docs.mapInArrow(_verified(clashing) if clashing else _recipes, schema)
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    groups = rows.groupBy("recipe").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups.select("recipe", F.col("first.id").alias("keep"), F.col("first.uid").alias("keep_uid"), "group_size"))
    out = join_table(rows, groups, ["recipe"], "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
        "text_sha256",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact copies among all documents."""
    return exact_groups(load(spark, sf_dir, "documents"))


SQL = r"""
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
"""
