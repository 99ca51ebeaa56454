"""Encodings of files and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Names that stand for code page 936, as its readers take them.
CODE_PAGE_936 = ("gb2312", "gbk", "gb18030")


def codec(name: str) -> str:
    """The codec for an encoding's name: code page 936 for the whole GB family."""
    return "gbk" if name.lower().replace("-", "").replace("_", "") in CODE_PAGE_936 else name


def encoding_of(content: bytes | None) -> str:
    """ascii, utf8, gb2312 (code page 936) or unknown (also: UTF-16 with a mark). Empty counts as ascii."""
    data = content or b""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "unknown"
    for name, reader in (("ascii", "ascii"), ("utf8", "utf-8"), ("gb2312", codec("gb2312"))):
        try:
            text = data.decode(reader)
        except UnicodeDecodeError:
            continue
        if text.encode(reader) == data:
            return name
    return "unknown"


def detect(files: DataFrame) -> DataFrame:
    """Adds ``encoding`` to ``path, content``: ascii, utf8, gb2312 (code page 936) or unknown (also: UTF-16 with a mark).
    Null and empty count as ascii.

    ASCII and UTF-8 are told by built-in functions; only the rows that they leave open go through Python, which
    knows the rows and cells of the code page.
    """
    content = F.coalesce("content", F.lit(b""))
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF")
    text = content.cast("string")
    known = F.when(marked, "unknown").when(F.is_valid_utf8(text), F.when(F.octet_length(text) == F.length(text), "ascii").otherwise("utf8"))
    files = files.drop("encoding").withColumn("encoding", known)

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = [encoding_of(x.as_py()) for x in b.column("content")]
            yield b.set_column(b.schema.get_field_index("encoding"), "encoding", pa.array(told, pa.string()))

    open_ = files.where("encoding is null")
    return files.where("encoding is not null").union(open_.mapInArrow(other, files.schema))


def verdict(encoding: Column, expected: str) -> Column:
    return F.when(encoding == expected, "ok").when(encoding == "ascii", "warning").otherwise("error")


def recode(files: DataFrame, source: str = "utf-8", target: str = "gb2312") -> DataFrame:
    """Adds ``recoded`` (null where it fails) and ``error``."""
    @F.pandas_udf("recoded binary, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(data):
            try:
                return (data or b"").decode(codec(source)).encode(codec(target)), None
            except UnicodeError as e:
                return None, type(e).__name__

        for b in batches:
            yield pd.DataFrame([one(x) for x in b], columns=["recoded", "error"])

    return files.withColumn("_r", run("content")).select("*", "_r.recoded", "_r.error").drop("_r")


def root_verdict(files: DataFrame, most: int = 20) -> DataFrame:
    """``root, files, verdict`` from the first ``most`` non-ASCII files of each root in path order."""
    other = F.col("encoding") != "ascii"
    # The place of the file after the last one that counts, per root: rows are cut to the first few per task.
    place = F.row_number().over(Window.partitionBy("root").orderBy("path"))
    end = files.where(other).select("root", "path", place.alias("_n")).where(F.col("_n") <= most + 1).where(F.col("_n") == most + 1).select("root", F.col("path").alias("_end"))
    kept = files.join(end, "root", "left").where(F.col("_end").isNull() | (F.col("path") < F.col("_end")))
    g = kept.groupBy("root").agg(F.count(F.lit(1)).alias("files"), *[F.count_if(F.col("encoding") == e).alias(e) for e in ("unknown", "utf8", "gb2312")])
    v = (F.when(F.col("unknown") > 0, "unknown").when((F.col("utf8") > 0) & (F.col("gb2312") > 0), "mixed")
         .when(F.col("utf8") > 0, "utf8").when(F.col("gb2312") > 0, "gb2312").otherwise("insufficient"))
    return g.select("root", "files", v.alias("verdict"))


def profile_state(roots: DataFrame) -> DataFrame:
    """Adds ``state`` from ``verdict`` and the ``declared`` encoding (null: none yet)."""
    v, d = F.col("verdict"), F.col("declared")
    state = (F.when(v.isin("unknown", "insufficient"), "review").when(d.isNull(), F.when(v == "mixed", "planned").otherwise("applied"))
             .when(d == v, "unchanged").otherwise("conflict"))
    return roots.withColumn("state", state)
