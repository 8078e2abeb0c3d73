"""Content-anchored spans that are carried over the versions of a text.

A span is known by its first and last line and by where they were; at the next version it is found
where those lines are nearest, and its anchors are picked anew there, so that it follows a text
through changes that would lose anchors picked once. Each version's anchors depend on the version
before: versions of a path stream through one worker in order, one text at a time, whatever their
number; paths are spread over workers. A path's spans are held, which are few.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a distinctive line, lines that an open end may grow by, or have at least,
#: lines of a span, and of a window that is read.
DISTINCTIVE, GROWTH, OPEN_END, MOST, WINDOW = 6, 50, 200, 400, 200


def pick(lines: list[str], start: int, end: int) -> tuple[str, str | None, int, int] | None:
    """Anchors of the lines start to end (from 1): first line, last line (None for an open end), where the first one
    is and how far the last one is from it. Without a line that isn't blank there are none."""
    end = min(end, len(lines))
    full = [i for i in range(max(1, start) - 1, end) if lines[i].strip()]
    if not full:
        return None
    times = Counter(lines)
    told = [i for i in full if len(lines[i].strip()) >= DISTINCTIVE and times[lines[i]] == 1]
    half = len(full) // 2
    upper, lower = set(full[: max(1, half)]), set(full[half:])
    first = next((i for i in told if i in upper), full[0])
    if end >= len(lines):
        return lines[first], None, first + 1, len(lines) - 1 - first
    last = next((i for i in reversed(told) if i in lower and i >= first), full[-1])
    return lines[first], lines[last], first + 1, last - first


def locate(lines: list[str], first: str, last: str | None, pos: int, length: int) -> tuple[int, int] | None:
    """Where a span is now: its first and last line (from 1), or None if its first line is gone."""
    starts = [i for i, x in enumerate(lines, 1) if x == first]
    if not starts:
        return None
    a = min(starts, key=lambda i: abs(i - pos))
    if last is None:
        b = a + max(length + GROWTH, OPEN_END)
    else:
        b = min((i for i, x in enumerate(lines, 1) if x == last and i >= a), key=lambda i: abs(i - a - length), default=a + length)
    return a, min(b, len(lines), a + MOST)


_STATE = pa.schema([("path", pa.string()), ("span", pa.int64()), ("version", pa.int64()), ("found", pa.bool_()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("observed", pa.string())])
_DDL = "path string, span long, version long, found boolean, start_line long, end_line long, first string, last string, observed string"


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a path: its spans, then its versions in order."""
    path, asked, anchors = object(), {}, {}
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["path"] != path:
                path, asked, anchors = r["path"], {}, {}
            if r["span"] is not None:
                asked[r["span"]] = (r["start"], min(r["end"], r["start"] + WINDOW - 1))
                continue
            if r["text"] is None:  # the path isn't there: spans wait
                out += [{"path": path, "span": s, "version": r["version"], "found": False} for s in asked]
                continue
            lines = r["text"].split("\n")
            for span, (start, end) in asked.items():
                held = anchors.get(span)
                at = locate(lines, *held) if held else None
                a, b = at or (start, min(end, len(lines)))
                held = pick(lines, a, b) or held
                anchors[span] = held
                told = dict(zip(("first", "last"), held)) if held else {}
                out.append({"path": path, "span": span, "version": r["version"], "found": at is not None, "start_line": a, "end_line": b, "observed": "\n".join(lines[a - 1 : b]), **told})
        yield pa.RecordBatch.from_pylist(out, schema=_STATE)


def carry(spans: DataFrame, versions: DataFrame) -> DataFrame:
    """Spans (path, span, start, end: lines of the path's first version, from 1) over versions (path, version, text; null
    where the path isn't there): path, span, version, found (by the anchors before), start_line, end_line, the anchors
    picked there (first, last; last is null for an open end), observed (the lines). A span whose first line is gone, and
    every span in the first version, shows its original window. Lines of any newline convention."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    none = lambda kind: F.lit(None).cast(kind)
    rows = spans.select("path", none("long").alias("version"), F.col("span").cast("long").alias("span"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), none("string").alias("text"))
    rows = rows.unionByName(versions.select("path", F.col("version").cast("long").alias("version"), none("long").alias("span"), none("long").alias("start"), none("long").alias("end"), text.alias("text")))
    return rows.repartition("path").sortWithinPartitions("path", F.asc_nulls_first("version"), "span").mapInArrow(_carry, _DDL)
