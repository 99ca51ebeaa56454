"""Trace diagnosis: summaries, operation counts, cost ranking, repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.shared import stored


def summary(logs: DataFrame, trace: str = "trace_id", ts: str = "ts") -> DataFrame:
    """Per trace: rows and seconds between the first and the last."""
    span = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / F.lit(1e6)
    return logs.groupBy(trace).agg(F.count(F.lit(1)).alias("rows"), span.alias("seconds"))


def classify(message: Column, signatures: list[tuple[str, str]], other: str = "other") -> Column:
    """The class of the first pattern that fits."""
    out = F.lit(other)
    for name, pattern in reversed(signatures):
        out = F.when(message.rlike(pattern), name).otherwise(out)
    return out


def costs(ops: DataFrame, keys: list[str], op: str, ms: str) -> DataFrame:
    """Per key and operation: calls, mean, estimated cost (mean x calls) and its share."""
    g = ops.groupBy(*keys, op).agg(F.count(F.lit(1)).alias("calls"), F.sum(ms).alias("cost_ms"))
    total = F.sum("cost_ms").over(Window.partitionBy(*keys)) if keys else F.sum("cost_ms").over(Window.partitionBy(F.lit(1)))
    return g.withColumn("mean_ms", F.col("cost_ms") / F.col("calls")).withColumn("share", F.col("cost_ms") / total)


def repeats(ops: DataFrame, trace: str, op: str, least: int = 3, share: float = 0.3) -> DataFrame:
    """Operations that a trace calls at least ``least`` times, with ``share`` of its calls and whether that is
    over the given one."""
    calls = ops.groupBy(trace, op).agg(F.count(F.lit(1)).alias("calls"))
    part = F.col("calls") / F.sum("calls").over(Window.partitionBy(trace))
    return calls.withColumn("share", part).withColumn("dominant", F.col("share") > share).where(F.col("calls") >= least)


def distribution(logs: DataFrame, trace: str, by: str) -> DataFrame:
    """``trace, by, rows, share``: how the rows of a trace spread over applications or loggers."""
    rows = logs.groupBy(trace, by).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(trace)))


def around(points: DataFrame, logs: DataFrame, key: str, seconds: int) -> DataFrame:
    """Rows of ``logs`` (``key, ts``) within ``seconds`` of a point (``key, at``) of the same key.

    Both sides meet by key and span of ``seconds``, a point in its own span and the two beside it, so a key
    with very many rows is worked on in parts.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = lambda c: F.floor(micros(c) / (seconds * 1_000_000))
    p = points.withColumn("_span", F.explode(F.sequence(span("at") - 1, span("at") + 1)))
    return p.join(logs.withColumn("_span", span("ts")), [key, "_span"]).where(F.abs(micros("ts") - micros("at")) <= seconds * 1_000_000).drop("_span")


def terms(df: DataFrame, field: str, most: int) -> DataFrame:
    """The ``most`` most frequent values of a field, ties by value."""
    return df.groupBy(field).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), field).limit(most)


def page(df: DataFrame, order: list, offset: int, limit: int, most: int = 1000) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in an order. A page of more than ``most`` rows is refused."""
    if limit > most:
        raise ValueError(f"a page has at most {most} rows, not {limit}")
    return df.orderBy(*order).offset(offset).limit(limit)


def numbered(df: DataFrame, order: list[str], as_: str = "row_no", parts: int | None = None) -> DataFrame:
    """``df`` with ``as_``: each row's number from 0 in the order of the columns ``order``, which tell rows apart.

    Rows are dealt over ranges of the order and kept; a row's number is its number in its range and the sum of the rows of
    the ranges before, of which there are ``parts`` (default: as many as shuffle partitions), so no task sees the whole table.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each range
    before, starts = 0, []
    for part in range(max(sizes, default=0) + 1):
        starts.append(F.lit(before).cast("long"))
        before += sizes.get(part, 0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn(as_, F.get(F.array(*starts), F.col("_part")) + inside - 1).drop("_part")


def pages(df: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """All pages at once: ``df`` with ``page`` and ``place`` (both from 0) and whether the page is ``short``, after which paging stops.
    The last page is short; where all pages are full, none is, and the page after the last would be empty."""
    rows = numbered(df, order)
    full = F.count(F.lit(1)).over(Window.partitionBy("page")) == size
    return (rows.withColumn("page", F.floor(F.col("row_no") / size)).withColumn("place", F.col("row_no") % size)
            .withColumn("short", ~full).drop("row_no"))


def search(df: DataFrame, must: dict[str, str] | None = None, phrase: tuple[str, str] | None = None,
           must_not: dict[str, str] | None = None, exists: list[str] | None = None) -> DataFrame:
    """Rows that match all fields of ``must``, hold the phrase, match none of ``must_not`` and have ``exists``."""
    cond = F.lit(True)
    for k, v in (must or {}).items():
        cond = cond & (F.col(k) == v)
    if phrase:
        cond = cond & F.contains(F.col(phrase[0]), F.lit(phrase[1]))
    for k, v in (must_not or {}).items():
        cond = cond & ~F.coalesce(F.col(k) == v, F.lit(False))
    for k in exists or []:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond)
