"""Streams of tasks and manifest events with bounded state.

Windowed counts use a watermark, so that state is dropped once an event time can no longer
arrive; the manifest keeps one row per path, the latest event of which wins however late
it comes; the TTL policy keeps one version number per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per tumbling window and kind; rows later than the watermark are dropped by the engine."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("__t", width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Sessions of a key: runs of events no further apart than the gap."""
    rows = events.withColumn("__t", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("__t", late) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window("__t", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(by, F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n")


def latest_manifest(log: DataFrame) -> DataFrame:
    """Changes (path, idx, sha) to the newest state of each path; an update-mode aggregate that corrects itself."""
    return log.groupBy("path").agg(F.max_by("sha", "idx").alias("sha"), F.max("idx").alias("idx"))


def ttl_reads(reads: DataFrame, k: int) -> DataFrame:
    """reads (iid, t, truth), in order of t, to iid, t, served, derived: an answer older than k versions is
    derived anew. One small state per key."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, served = state.get if state.exists else (None, None)
        for frame in frames:
            out = []
            for r in frame.sort_values("t").itertuples(index=False):
                new = last is None or r.t - last >= k
                if new:
                    last, served = r.t, r.truth
                out.append((key[0], r.t, served, new))
            if out:
                state.update((int(last), served))
                yield pd.DataFrame(out, columns=["iid", "t", "served", "derived"])

    return reads.groupBy("iid").applyInPandasWithState(step, "iid long, t long, served string, derived boolean", "last long, served string", "append", GroupStateTimeout.NoTimeout)
