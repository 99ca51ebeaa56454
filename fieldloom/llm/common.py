"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.shared import Steps, table

__all__ = ["Steps", "fresh", "materialize", "portions", "salted_join", "table", "unit_hash"]

#: Bytes of text that a Python worker turns into objects at once.
PORTION = 1_000_000


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and gives real sizes."""
    return Steps(df.sparkSession).keep(df)


def portions(batches: Iterator[pa.RecordBatch], text: str, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts hold about ``size`` bytes (one longer text is a slice of
    its own), so that a worker's memory depends neither on Arrow's batch size nor on long rows."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(ends // size)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if j > i:
                yield b.slice(i, j - i)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that no column of ``df`` has it."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def unit_hash(*cols) -> "F.Column":
    """A uniform double in [0, 1): the first 52 bits of an MD5, equal in any engine."""
    digest = F.substring(F.md5(F.concat_ws("|", *cols)), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**52))


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 16, how: str = "left") -> DataFrame:
    """Join a skewed ``left`` to a ``right`` that is unique on ``key``: ``right`` is repeated per salt.

    A key with any share of the left rows is spread over ``salts`` partitions. ``right`` is
    small beside ``left`` (one row per key), so repeating it is cheap.
    """
    salt, = fresh(left.select(*left.columns, *[F.lit(0).alias(c) for c in right.columns]), "_salt")
    hashed = [F.col(f.name) for f in left.schema.fields if f.name != key and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    row = F.pmod(F.xxhash64(*hashed or [F.rand(7)]), F.lit(salts)).cast("int")
    a = left.withColumn(salt, row)
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [key, salt], how).drop(salt)
