"""What the two operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec``: one row per non-null key with a vector that is not null and holds only
    finite numbers. Rows that repeat a key count once, with the least vector among them."""
    x = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vec")).where("id is not null and vec is not null")
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.where(~bad).groupBy("id").agg(F.min("vec").alias("vec"))


def matrix(column) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled up with zeros."""
    rows = [np.asarray(v, np.float64) for v in column]
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``keys``, one table each."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            held.append(b.slice(i, j - i))
            if j < b.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)
