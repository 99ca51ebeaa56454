"""Structured data inside text: pipe tables, settings, front matter, JSON exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators.encodings import codec

def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line`` of every text."""
    return df.select(key, F.posexplode(F.split(text, "\r?\n", -1)).alias("line_no", "line"))


def pipe_rows(by_line: DataFrame, key: str, least: int = 2) -> DataFrame:
    """``key, line_no, cells`` of Markdown table rows of at least ``least`` cells, without separators."""
    t = F.trim("line")
    cells = F.transform(F.split(F.regexp_replace(t, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return by_line.where(t.startswith("|")).withColumn("cells", cells).where((F.size("cells") >= least) & ~F.forall("cells", lambda c: c.rlike("^:?-+:?$"))).select(
        key, "line_no", "cells")


def settings(by_line: DataFrame, key: str) -> DataFrame:
    """``key, name, value`` of ``- name: value`` lines (ASCII or full-width colon); the first of a name wins."""
    pattern = r"^\s*-\s*([^:：]+?)\s*[:：]\s*(.*?)\s*$"
    df = by_line.select(key, "line_no", F.regexp_extract("line", pattern, 1).alias("name"), F.regexp_extract("line", pattern, 2).alias("value")).where("name <> ''")
    first = F.row_number().over(Window.partitionBy(key, "name").orderBy("line_no"))
    return df.withColumn("_n", first).where("_n = 1").select(key, "name", "value")


def front_matter(by_line: DataFrame, key: str) -> DataFrame:
    """Lines between a leading ``---`` and the next one; nothing where it is not closed."""
    w = Window.partitionBy(key).orderBy("line_no")
    fence = (F.trim("line") == "---").cast("int")
    df = by_line.withColumn("_f", F.sum(fence).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_all", F.sum(fence).over(Window.partitionBy(key))).withColumn("_first", F.first(F.trim("line")).over(w))
    return df.where("_first = '---' and _all >= 2 and _f = 1 and trim(line) <> '---'").select(key, "line_no", "line")


def front_matter_fields(front: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``key, name, value`` of the chosen fields, continuation lines joined by blanks."""
    named = F.regexp_extract("line", r"^([A-Za-z_][\w-]*)\s*:", 1)
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    df = front.withColumn("_own", F.nullif(named, F.lit(""))).withColumn("name", F.last("_own", ignorenulls=True).over(w)).where(F.col("name").isin(*names))
    value = F.trim(F.when(F.col("_own").isNotNull(), F.regexp_replace("line", r"^[A-Za-z_][\w-]*\s*:", "")).otherwise(F.col("line")))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", value.alias("v"))))  # one short field
    return df.groupBy(key, "name").agg(F.trim(F.array_join(F.transform(ordered, lambda x: x["v"]), " ")).alias("value"))


def status_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block, name, value`` of ``name : value`` lines in blocks parted by blank lines."""
    blocks = df.select(key, F.posexplode(F.split(text, r"\r?\n\s*\r?\n")).alias("block", "_b"))
    ls = blocks.select(key, "block", F.explode(F.split("_b", r"\r?\n")).alias("_l"))
    return ls.select(key, "block", F.regexp_extract("_l", r"^\s*([\w-]+)\s*:\s*(.*?)\s*$", 1).alias("name"),
                     F.regexp_extract("_l", r"^\s*([\w-]+)\s*:\s*(.*?)\s*$", 2).alias("value")).where("name <> ''")


_MESSAGE = "full_message:string,timestamp:string,traceId:string"
LOG_EXPORT = f"total_results long, messages array<struct<{_MESSAGE},message:struct<{_MESSAGE}>>>"


def log_export(spark: SparkSession, path: str) -> DataFrame:
    """``seq, full_message, timestamp, traceId, total_results`` of a JSON export, whose messages may be nested
    under ``message``; ``seq`` is their order in the file, ``total_results`` what the search matched in all."""
    raw = spark.read.option("multiLine", True).schema(LOG_EXPORT).json(path)
    m = raw.select("total_results", F.posexplode("messages").alias("seq", "m"))
    pick = lambda c: F.coalesce(f"m.{c}", f"m.message.{c}").alias(c)
    return m.select("seq", pick("full_message"), pick("timestamp"), pick("traceId"), "total_results")


def feedback_entries(df: DataFrame, column: str = "json") -> DataFrame:
    """``key, candidate, confidence, reason, seq`` of a feedback object: texts or objects by key, bare
    or under ``fields``."""
    inner = F.coalesce(F.get_json_object(column, "$.fields"), F.col(column))
    m = df.select(F.from_json(inner, "map<string,string>").alias("_m")).select(F.posexplode(F.map_entries("_m")).alias("seq", "_e"))
    obj = F.from_json("_e.value", "candidate string, confidence double, reason string")
    is_obj = F.col("_e.value").startswith("{")
    return m.select(F.col("_e.key").alias("key"), F.when(is_obj, obj["candidate"]).otherwise(F.col("_e.value")).alias("candidate"),
                    F.when(is_obj, obj["confidence"]).alias("confidence"), F.when(is_obj, obj["reason"]).alias("reason"), "seq")


def json_object(c) -> "F.Column":
    """The text of a JSON object without a leading byte-order mark; null for anything whose root is no object."""
    bare = F.trim(F.regexp_replace(c, "^\ufeff", ""))
    return F.when(bare.startswith("{") & F.try_parse_json(bare).isNotNull(), bare)


def yaml_values(by_line: DataFrame, key: str) -> DataFrame:
    """``key, name, at, value``: the top-level scalars (``at`` 0) and list items (``at`` from 1) of a simple YAML text.
    Quotes around a value and comments after a blank are dropped; of a repeated name the first counts."""
    line = F.col("line")
    scalar = r"^([A-Za-z_][\w-]*)\s*:\s*(.*)$"
    w = Window.partitionBy(key).orderBy("line_no")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    own = F.nullif(F.regexp_extract(line, scalar, 1), F.lit(""))
    df = by_line.select(key, "line_no", "line", own.alias("_own")).withColumn("name", F.last("_own", ignorenulls=True).over(upto))
    df = df.withColumn("_block", F.count("_own").over(upto)).where("name is not null")
    item = F.regexp_extract(line, r"^\s*-\s+(.*)$", 1)
    raw = F.when(F.col("_own").isNotNull(), F.regexp_extract(line, scalar, 2)).otherwise(item)
    bare = F.trim(F.regexp_replace(raw, r"(^|\s)#.*$", ""))
    value = F.regexp_replace(bare, r"""^(["'])(.*)\1$""", "$2")
    df = df.withColumn("value", value).where("value <> ''")
    first = F.min("_block").over(Window.partitionBy(key, "name"))
    df = df.withColumn("_first", first).where("_block = _first")
    inside = Window.partitionBy(key, "name").orderBy("line_no")
    at = F.when(F.col("_own").isNotNull(), 0).otherwise(F.count(F.when(F.col("_own").isNull(), 1)).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return df.select(key, "name", at.cast("int").alias("at"), "value")


def xml_text(content) -> "F.Column":
    """The text of XML bytes in the encoding that they declare (UTF-8 without one, code page 936 for the GB family); what
    does not decode is null. Encodings beyond UTF-8 have to be decoded in Python."""
    @F.pandas_udf("string")
    def run(contents: pd.Series) -> pd.Series:
        def one(data):
            if data is None:
                return None
            head = re.match(rb"""\s*<\?xml[^>]*encoding\s*=\s*["']([^"']+)["']""", data[:200])
            try:
                return bytes(data).decode(codec(head[1].decode("ascii")) if head else "utf-8-sig")
            except (LookupError, UnicodeDecodeError):
                return None

        return contents.map(one)

    return run(content)
