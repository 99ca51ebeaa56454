"""Matching of catalogue fields to canonical names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: Key, candidate, confidence, reason.
BUILTIN_RULES = [
    ("patientid", "patient.id", 0.98, "通用字段规则：患者唯一标识"), ("patient_id", "patient.id", 0.98, "通用字段规则：患者唯一标识"),
    ("patientname", "patient.name", 0.98, "通用字段规则：患者姓名"), ("patient_name", "patient.name", 0.98, "通用字段规则：患者姓名"),
    ("visitno", "visit.no", 0.95, "通用字段规则：就诊号"), ("visit_no", "visit.no", 0.95, "通用字段规则：就诊号"),
    ("orderno", "order.no", 0.95, "通用字段规则：订单号"), ("order_no", "order.no", 0.95, "通用字段规则：订单号"),
    ("orderid", "order.id", 0.95, "通用字段规则：订单标识"), ("order_id", "order.id", 0.95, "通用字段规则：订单标识"),
    ("code", "response.code", 0.94, "通用字段规则：响应状态码"), ("msg", "response.message", 0.94, "通用字段规则：响应消息"),
    ("message", "response.message", 0.94, "通用字段规则：响应消息"), ("data", "response.data", 0.9, "通用字段规则：响应数据"),
]
#: Ordered patterns, candidate, reason.
HINTS = [
    ("(?i)visit|就诊|诊疗", "visit.identifier", "字段文本包含就诊语义"),
    ("(?i)order|订单|医嘱", "order.identifier", "字段文本包含订单/医嘱语义"),
    ("(?i)patient|患者|病人", "patient.identifier", "字段文本包含患者语义"),
]
FEEDBACK_CONFIDENCE, REVIEW_BELOW, HINT_CONFIDENCE = 0.95, 0.9, 0.62
RULE_SCHEMA = "key string, candidate string, confidence double, reason string"


def rules(spark) -> DataFrame:
    return spark.createDataFrame(BUILTIN_RULES, RULE_SCHEMA)


def feedback(entries: DataFrame) -> DataFrame:
    """Rules from feedback rows ``key, candidate, confidence, reason, seq``: blank candidates
    go, keys are normalised, of equal keys the last (by ``seq``) wins."""
    e = entries.withColumn("key", T.match_key(F.col("key"))).withColumn("candidate", F.trim(F.coalesce("candidate", F.lit("")))).where("candidate <> ''")
    last = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return e.withColumn("_n", last).where("_n = 1").select(
        "key", "candidate", F.coalesce("confidence", F.lit(FEEDBACK_CONFIDENCE)).alias("confidence"), F.coalesce("reason", F.lit("项目本地反馈命中")).alias("reason"))


def _lookup(fields: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: the rule of the first of the field's three keys that has one.

    One hash join per key; rule tables are small and Spark broadcasts them below its size limit.
    """
    for i in range(3):
        r = table.select(F.col("key").alias(f"_k{i}"), F.struct("candidate", "confidence", "reason").alias(f"_{name}{i}"))
        fields = fields.join(r, f"_k{i}", "left")
    return fields.withColumn(name, F.coalesce(*[f"_{name}{i}" for i in range(3)])).drop(*[f"_{name}{i}" for i in range(3)])


def hint(text: Column) -> Column:
    out = F.lit(None).cast("struct<candidate:string,reason:string>")
    for pattern, candidate, reason in reversed(HINTS):
        out = F.when(text.rlike(pattern), F.struct(F.lit(candidate).alias("candidate"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def match(fields: DataFrame, local: DataFrame, builtin: DataFrame) -> DataFrame:
    """Columns of ``fields`` (``code, name, json_path, description`` used) with ``matched, candidate,
    confidence, reason, match_source, needs_review``: local rules before built-in ones, by
    code, then name, then path; else an ordered hint of low confidence; else nothing."""
    key = lambda c: T.match_key(F.col(c))
    df = fields.withColumns({"_k0": key("code"), "_k1": key("name"), "_k2": key("json_path")})
    df = _lookup(_lookup(df, local, "_local"), builtin, "_rule")
    spoken = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("code", "name", "description", "json_path")])
    df = df.withColumn("_hint", hint(spoken))
    l, r, h = F.col("_local").isNotNull(), F.col("_rule").isNotNull(), F.col("_hint").isNotNull()
    return df.withColumns({
        "matched": l | r,
        "candidate": F.coalesce("_local.candidate", "_rule.candidate", "_hint.candidate", F.lit("")),
        "confidence": F.coalesce("_local.confidence", "_rule.confidence", F.when(h, F.lit(HINT_CONFIDENCE)), F.lit(0.0)),
        "reason": F.coalesce("_local.reason", "_rule.reason", "_hint.reason", F.lit("未找到可靠通用规则或项目本地反馈")),
        "match_source": F.when(l, "local-feedback").when(r, "builtin-rule").when(h, "low-confidence-candidate").otherwise("unmatched"),
        "needs_review": F.when(l, F.col("_local.confidence") < REVIEW_BELOW).otherwise(~r),
    }).drop("_k0", "_k1", "_k2", "_local", "_rule", "_hint")


def summary(matches: DataFrame, *keys: str) -> DataFrame:
    source = lambda s: F.count_if(F.col("match_source") == s)
    return matches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("matched").alias("matched"), source("local-feedback").alias("feedback"),
        source("low-confidence-candidate").alias("low_confidence"), source("unmatched").alias("unmatched"), F.count_if("needs_review").alias("review"))


#: Headings and texts of the match report.
REPORT_HEAD, SUMMARY_HEAD, RESULT_HEAD, REVIEW_HEAD, UNMATCHED_HEAD, NOTHING = "# Field Match", "## 字段匹配摘要", "## 匹配结果", "## 需人工确认", "## 未匹配字段", "- 暂无。"
REPORT_COLUMNS = ("字段代码", "字段名称", "候选", "置信度", "来源", "需人工确认", "原因")
REPORT_COUNTS = (("totalFields", "total"), ("matched", "matched"), ("localFeedback", "feedback"), ("lowConfidenceCandidates", "low_confidence"), ("unmatched", "unmatched"), ("needsReview", "review"))


def report(matches: DataFrame) -> DataFrame:
    """``doc_id, part, sheet, at, line_no, line``: the match report of each document as lines, in the order of these columns.

    ``matches`` is what ``match`` gives for fields with ``doc_id, sheet, row_idx``. The parts are the summary (0), a table for
    each view (1), the fields to review (2) and those of them without a match (3). A document's lines are rows of
    their own, so a document of any size is no single row; ``sheet`` and ``at`` (the field's row) are null but in the lines of views and fields.
    """
    esc = lambda c: T.escape_cell(F.col(c).cast("string"))
    none = F.lit(None)

    def lines(df: DataFrame, part: int, sheet, at, array) -> DataFrame:
        return df.select("doc_id", F.lit(part).alias("part"), sheet.cast("string").alias("sheet"), at.cast("long").alias("at"), F.posexplode(array).alias("line_no", "line"))

    counts = summary(matches, "doc_id")
    said = [F.concat(F.lit(f"- {name}: `"), F.col(c).cast("string"), F.lit("`")) for name, c in REPORT_COUNTS]
    named = F.concat(F.lit("- document: `"), esc("doc_id"), F.lit("`"))
    head = lines(counts, 0, none, none, F.array(*map(F.lit, (REPORT_HEAD, "", SUMMARY_HEAD, "")), named, *said, *map(F.lit, ("", RESULT_HEAD, ""))))
    table_head = F.array(F.concat(F.lit("### "), esc("sheet")), F.lit(""), F.lit("| " + " | ".join(REPORT_COLUMNS) + " |"), F.lit("| " + " | ".join(["---"] * len(REPORT_COLUMNS)) + " |"))
    views = matches.select("doc_id", "sheet").distinct()
    first = lines(views, 1, F.col("sheet"), F.lit(-1), table_head)
    last = lines(views, 1, F.col("sheet"), F.lit(2**62), F.array(F.lit("")))
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("code", "name", "candidate", "confidence", "match_source")], F.when(F.col("needs_review"), "Y").otherwise("N"), F.coalesce("reason", F.lit("")))
    rows = lines(matches, 1, F.col("sheet"), F.col("row_idx"), F.array(T.markdown_row(cells, len(REPORT_COLUMNS))))

    def listed(part: int, heading: tuple[str, ...], chosen: DataFrame, line) -> DataFrame:
        own = chosen.groupBy("doc_id").agg(F.lit(True).alias("_some"))
        titles = lines(counts.select("doc_id").join(own, "doc_id", "left"), part, none, none, F.concat(F.array(*map(F.lit, heading)), F.when(F.col("_some"), F.array().cast("array<string>")).otherwise(F.array(F.lit(NOTHING)))))
        return titles.union(lines(chosen, part, F.col("sheet"), F.col("row_idx"), F.array(line)))

    code = F.concat(F.lit("- `"), esc("code"), F.lit("`"))
    review = matches.where("needs_review")
    out = head.union(first).union(rows).union(last)
    out = out.union(listed(2, (REVIEW_HEAD, ""), review, F.concat(code, F.lit(": "), esc("reason"))))
    return out.union(listed(3, ("", UNMATCHED_HEAD, ""), review.where("match_source = 'unmatched'"), F.concat(code, F.lit(" "), esc("name"))))
