"""Slow calls from application logs: extract, aggregate, rank, group, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: Module prefix, group and display name; the order decides between prefixes.
PRODUCT_GROUPS = [
    ("ipnur", "护理", "住院护理"), ("emnur", "护理", "急诊护理"),
    ("ipcare", "医生站", "住院医生站"), ("opcare", "医生站", "门急诊医生站"), ("hispa", "医生站", "患者主索引"),
    ("ipar", "计费医保", "住院计费"), ("insu", "计费医保", "医保"),
    ("ipemr", "电子病历", "住院电子病历"), ("ipnemr", "电子病历", "护理电子病历"), ("opemr", "电子病历", "门诊电子病历"),
    ("ph", "药房药库", "药房药库"),
    ("aggregation", "临床数据中心", "临床数据中心"), ("lis", "临床数据中心", "LIS"),
    ("cons", "会诊", "会诊管理"), ("requ", "会诊", "会诊申请"),
    ("ct", "基础平台", "基础平台"), ("hos", "HOS平台", "HOS平台"), ("mrm", "电子病案管理", "电子病案管理"),
    ("emdt", "新产品", "急诊医技"), ("emtr", "新产品", "急诊分诊"), ("emcare", "新产品", "急诊诊疗"),
]
OTHER = "其他"


def calls(messages: DataFrame) -> DataFrame:
    """``seq, full_name, ms, trace_id, ts`` of the messages that name an interface.

    ``messages``: ``seq, full_message, timestamp, traceId``; ``seq`` is the order of arrival.
    """
    return messages.select("seq", T.interface_name(F.col("full_message")).alias("full_name"), T.duration_ms(F.col("full_message")).alias("ms"),
                           F.coalesce("traceId", F.lit("")).alias("trace_id"), F.col("timestamp").alias("ts")).where("full_name is not null")


def product_group(name: Column, root: str, skip: str = "his", groups: list | None = None) -> Column:
    """The group of the first prefix that the module begins with, else OTHER."""
    module, out = T.module_after(name, root, skip), F.lit(OTHER)
    for prefix, group, _ in reversed(groups or PRODUCT_GROUPS):
        out = F.when(module.startswith(prefix), group).otherwise(out)
    return out


def stats(called: DataFrame, root: str) -> DataFrame:
    """Per interface: count, maximum with the trace and time of its first occurrence, mean, first
    seq, short name, group and severity."""
    top = F.max(F.struct(F.col("ms").alias("ms"), (-F.col("seq")).alias("nseq"), F.col("trace_id"), F.col("ts")))
    aggs = [F.count(F.lit(1)).alias("calls"), top.alias("_top"), F.sum("ms").alias("total_ms"), F.min("seq").alias("first_seq")]
    out = called.groupBy("full_name").agg(*aggs)
    hit = F.col("_top.ms") > 0  # without a duration there is no slowest call to point at
    out = out.select("full_name", T.last_segment(F.col("full_name")).alias("short_name"), product_group(F.col("full_name"), root).alias("product_group"), "calls",
                     F.col("_top.ms").alias("max_ms"), F.when(hit, F.col("_top.trace_id")).otherwise("").alias("max_trace"),
                     F.when(hit, F.col("_top.ts")).alias("max_ts"), (F.col("total_ms") / F.col("calls")).alias("mean_ms"),
                     T.severity(F.col("_top.ms")).alias("severity"), "first_seq")
    return out


def durations(called: DataFrame, span: int = 10_000) -> DataFrame:
    """``full_name, part, ms, times``: the durations and times of an interface in order of arrival, as lists of
    the calls of ``span`` numbers each, so that a row stays small however often an interface is called."""
    parts = called.groupBy("full_name", F.floor(F.col("seq") / span).alias("part")).agg(F.array_sort(F.collect_list(F.struct("seq", "ms", "ts"))).alias("_all"))
    return parts.select("full_name", "part", F.col("_all.ms").alias("ms"), F.col("_all.ts").alias("times"))


def ranked(by_interface: DataFrame, top: int) -> DataFrame:
    """The ``top`` interfaces by maximum, ties by first occurrence, with their rank."""
    best = by_interface.orderBy(F.desc("max_ms"), "first_seq").limit(top)
    # At most ``top`` rows are numbered.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("max_ms"), "first_seq")))


def in_groups(by_interface: DataFrame) -> DataFrame:
    """The interfaces by group name, inside a group by maximum, ties by first occurrence."""
    return by_interface.orderBy("product_group", F.desc("max_ms"), "first_seq")


def by_group(by_interface: DataFrame) -> DataFrame:
    return by_interface.groupBy("product_group").agg(F.count(F.lit(1)).alias("interfaces"), F.sum("calls").alias("calls"), F.max("max_ms").alias("worst_ms"))


def severities(by_interface: DataFrame) -> DataFrame:
    return by_interface.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("high", "mid", "low")])


def envelope(messages: DataFrame, total: int | None = None) -> DataFrame:
    """Messages that the search matched in all (``total``, as the export says; default: the sampled ones),
    sampled messages and distinct interfaces."""
    sampled = F.count(F.lit(1))
    matched = sampled if total is None else F.lit(total).cast("long")
    return messages.agg(matched.alias("total"), sampled.alias("sampled"), F.countDistinct(T.interface_name(F.col("full_message"))).alias("interfaces"))


def slow_ratio(messages: DataFrame, keys: list[str], slow_ms: int = 15000) -> DataFrame:
    """Share of slow calls per key and its risk band."""
    slow = F.count_if(T.duration_ms(F.col("full_message")) >= slow_ms)
    out = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), slow.alias("slow"))
    ratio = F.col("slow") * 100.0 / F.col("total")
    band = F.when(ratio > 50, "critical").when(ratio >= 10, "high").when(ratio >= 1, "medium").otherwise("low")
    return out.withColumn("ratio", ratio).withColumn("band", band)


def text_report(by_interface: DataFrame, top: int = 50) -> DataFrame:
    """``section, line_no, line``: the ranking, the groups and the severities as lines of text."""
    rank = ranked(by_interface, top).select(F.lit("rank").alias("section"), F.col("rank").alias("line_no"), F.concat_ws(
        " ", F.concat("rank", F.lit(".")), "short_name", F.concat(T.seconds(F.col("max_ms")), F.lit("s")), F.concat(F.lit("x"), "calls"), "product_group"))
    groups = by_group(by_interface)
    # One row per product group, a short fixed list.
    groups = groups.select(F.lit("group"), F.row_number().over(Window.orderBy("product_group")), F.concat_ws(
        " ", "product_group", F.concat(F.col("interfaces").cast("string"), F.lit(" interfaces")), F.concat(T.seconds(F.col("worst_ms")), F.lit("s"))))
    counts = severities(by_interface).select(F.lit("severity"), F.lit(1), F.concat_ws(
        " ", *[F.concat(F.lit(f"{s}="), F.col(s).cast("string")) for s in ("high", "mid", "low")]))
    return rank.union(groups).union(counts).toDF("section", "line_no", "line")


def report(by_interface: DataFrame, top: int = 20) -> DataFrame:
    """The ranking as lines of a Markdown table: ``line_no, line``."""
    cells = F.array(F.col("rank").cast("string"), "short_name", "product_group", F.col("calls").cast("string"), T.seconds(F.col("max_ms")), "severity")
    body = ranked(by_interface, top).select((F.col("rank") + 1).alias("line_no"), T.markdown_row(cells, 6).alias("line"))
    head = by_interface.sparkSession.createDataFrame([(0, "| # | interface | group | calls | max s | severity |"), (1, "| --- | --- | --- | --- | --- | --- |")], "line_no int, line string")
    return head.union(body)
