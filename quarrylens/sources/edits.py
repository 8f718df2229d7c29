"""The smallest byte edit between two versions of a text: what is left between common ends."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarrylens.session import ship_package

_FIELDS = ("start_byte", "old_end_byte", "new_end_byte", "start_row", "start_column", "old_end_row", "old_end_column", "new_end_row", "new_end_column")


def _point(raw: bytes, at: int) -> tuple[int, int]:
    """Row and byte column of a place."""
    line = raw.rfind(b"\n", 0, at) + 1
    return raw.count(b"\n", 0, at), at - line


def input_edit(old: str, new: str) -> dict[str, int] | None:
    """Start, old end and new end of the edit, in bytes and as points; none if nothing changed."""
    a, b = old.encode("utf-8", "surrogatepass"), new.encode("utf-8", "surrogatepass")
    if a == b:
        return None
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    differs = np.flatnonzero(x[:n] != y[:n])
    start = int(differs[0]) if len(differs) else n
    left = n - start
    tail = np.flatnonzero(x[len(a) - left :][::-1] != y[len(b) - left :][::-1])
    same = int(tail[0]) if len(tail) else left
    ends = (start, len(a) - same, len(b) - same)
    points = (*_point(a, ends[0]), *_point(a, ends[1]), *_point(b, ends[2]))
    return dict(zip(_FIELDS, (*ends, *points), strict=True))


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(p, input_edit(o or "", n or "")) for p, o, n in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        rows = [(p, e) for p, e in rows if e]
        cols = [pa.array([p for p, _ in rows], pa.string()), *(pa.array([e[f] for _, e in rows], pa.int64()) for f in _FIELDS)]
        yield pa.RecordBatch.from_arrays(cols, names=["path", *_FIELDS])


def edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new: path, content -> one row for each path in both whose text differs."""
    ship_package(old.sparkSession)
    both = old.select("path", F.col("content").alias("old")).join(new.select("path", F.col("content").alias("new")), "path")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).mapInArrow(_edits, "path string, " + ", ".join(f"{f} long" for f in _FIELDS))
