"""Nested data as rows of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _entries(value: Column, kind: T.DataType, path: str, at: Column) -> Column:
    """(path, ordinals, value) of all leaves of ``value``: one expression for each level of the schema."""
    if isinstance(kind, T.StructType):
        inner = [_entries(value.getField(f.name), f.dataType, f"{path}.{f.name}" if path else f.name, at) for f in kind.fields]
        return F.concat(*inner) if inner else F.array(_leaf(None, path, at))
    if isinstance(kind, T.ArrayType):
        below = F.flatten(F.transform(value, lambda x, i: _entries(x, kind.elementType, f"{path}[]", F.concat(at, F.array(i)))))
        return F.when(F.size(value) > 0, below).otherwise(F.array(_leaf(None, f"{path}[]", at)))
    if isinstance(kind, T.MapType):
        pairs = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.cast("string").alias("key"), F.element_at(value, k).alias("value")))
        row = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", kind.valueType)])
        return _entries(pairs, T.ArrayType(row), path, at)
    return F.array(_leaf(value, path, at))


def _leaf(value: Column | None, path: str, at: Column) -> Column:
    return F.struct(F.lit(path).alias("path"), at.alias("at"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def flatten_paths(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, path, at, value``: a row for each leaf of the other columns.

    A path is written ``a.b`` for fields and ``a[]`` for the elements of an array; ``at`` holds the elements' numbers from 0,
    outermost first. The schema is compiled to one expression over each row, so arrays beside each other are not multiplied and
    nothing is shuffled. A null or empty array gives one row of its ``a[]`` without a number of its own and a null value; a
    null struct gives its leaves as nulls. Maps are arrays of ``key`` and ``value`` in the order of the keys. Values are
    strings; variants and the like as Spark writes them.
    """
    kind = T.StructType([f for f in df.schema.fields if f.name not in keys])
    none = F.array().cast("array<int>")
    parts = [_entries(F.col(f"`{f.name}`"), f.dataType, f.name, none) for f in kind.fields]
    entry = F.explode(F.concat(*parts)).alias("e")
    return df.select(*keys, entry).select(*keys, "e.path", "e.at", "e.value")
