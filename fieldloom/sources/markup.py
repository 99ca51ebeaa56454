"""XML texts as typed objects, and back."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A part of a path that stands for an element's own text, and what begins the part of an attribute.
VALUE, ATTRIBUTE = "_VALUE", "_"
_PART = "\x1f"


def _shape(text: str) -> dict[tuple[str, ...], int]:
    """The paths below the root of an XML text, with the most elements of the path's name that one parent has."""
    found: Counter = Counter()
    stack = [((), ElementTree.fromstring(text))]
    while stack:
        path, element = stack.pop()
        for name, n in Counter(child.tag for child in element).items():
            found[*path, name] = max(found[*path, name], n)
        for name in element.attrib:
            found[*path, ATTRIBUTE + name] = 1
        if path and (element.attrib or len(element)) and (element.text or "").strip():
            found[*path, VALUE] = 1
        stack += [((*path, child.tag), child) for child in element]
    return found


def xml_schema(df: DataFrame, text: str) -> T.StructType:
    """The schema that all XML texts of a column share: an element is an array where any parent repeats it, a struct where any has
    children or attributes, else a string. Texts that don't parse and nulls say nothing.

    Each task tells the paths of its texts once, and the paths are put together by a partial maximum; what reaches the driver is as long as
    the schema.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[str, ...], int] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                try:
                    found = _shape(x) if x else {}
                except ElementTree.ParseError:
                    continue
                for path, n in found.items():
                    most[path] = max(most.get(path, 0), n)
        yield pa.RecordBatch.from_arrays([pa.array([_PART.join(p) for p in most], pa.string()), pa.array(list(most.values()), pa.int64())], ["path", "most"])

    rows = df.select(text).mapInArrow(run, "path string, most long").groupBy("path").agg(F.max("most").alias("most")).collect()
    paths = {tuple(r["path"].split(_PART)): r["most"] for r in rows}

    def kind(path: tuple[str, ...]) -> T.DataType:
        own = struct(path)
        return own if own.fields else T.StringType()

    def struct(path: tuple[str, ...]) -> T.StructType:
        below = sorted(p for p in paths if len(p) == len(path) + 1 and p[: len(path)] == path)
        return T.StructType([T.StructField(p[-1], T.ArrayType(kind(p)) if paths[p] > 1 else kind(p)) for p in below])

    return struct(())


def xml_objects(df: DataFrame, text: str, as_: str = "object", schema: T.StructType | None = None) -> DataFrame:
    """``df`` with ``as_``: each XML text's root as a struct of ``schema`` (default: ``xml_schema`` of the column). A repeated element is a list, and so is
    the same element elsewhere, be it there once or not at all (null). Null for texts that don't parse."""
    schema = schema or xml_schema(df, text)
    with_bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    read = F.from_xml(text, with_bad, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    out = df.withColumn("_read", read)
    whole = F.struct(*[F.col("_read").getField(f.name).alias(f.name) for f in schema.fields]) if schema.fields else F.struct()
    return out.withColumn(as_, F.when(F.col("_read").isNotNull() & F.col("_read._corrupt").isNull(), whole)).drop("_read")


def objects_xml(value: Column, root: str) -> Column:
    """A struct as XML with ``root``: lists as repeated elements, nulls left out. The inverse of ``xml_objects`` but for white space and the order of
    elements of unlike names."""
    return F.regexp_replace(F.to_xml(value, {"rowTag": root}), r">\s*\n\s*<", "><")
