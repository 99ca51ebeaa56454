"""Field catalogues and matching over ``part``, read as tables of field descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import catalogue, matching
from fieldloom.plans.registry import query
from fieldloom.shared import table

#: A table per brand: a title, a header, a row per part. Spark and DuckDB share the words but for arrays.
ROWS = """
SELECT p_brand AS doc_id, 'S1' AS sheet, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + 1 AS INT) AS row_idx,
       CASE WHEN p_partkey % 10 = 0 THEN '请求示例' WHEN p_partkey % 7 = 0 THEN concat('*', replace(p_name, ' ', '_')) ELSE replace(p_name, ' ', '_') END AS c1,
       concat(' ', p_type, '  x') AS c2, CASE p_size % 3 WHEN 0 THEN 'String' WHEN 1 THEN 'Long' ELSE '' END AS c3,
       CASE p_size % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'Y' ELSE '' END AS c4, CASE p_size % 5 WHEN 0 THEN '否' WHEN 1 THEN '是' ELSE '' END AS c5,
       CASE WHEN p_size = 7 THEN '0' ELSE '' END AS c6 FROM part"""
HEADER = ("字段名", "中文名", "数据类型", "是否必填", "允许空", "默认值")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    body = spark.sql(ROWS.replace("FROM part", "FROM {p}"), p=p).select("doc_id", "sheet", "row_idx", F.array("c1", "c2", "c3", "c4", "c5", "c6").alias("cells"))
    docs = p.select(F.col("p_brand").alias("doc_id"), F.lit("S1").alias("sheet")).distinct()
    title = docs.select("doc_id", "sheet", F.lit(0).alias("row_idx"), F.array(F.lit("接口"), F.col("doc_id")).alias("cells"))
    head = docs.select("doc_id", "sheet", F.lit(1).alias("row_idx"), F.array(*[F.lit(h) for h in HEADER]).alias("cells"))
    skipped = docs.select("doc_id", F.lit("S0").alias("sheet"), F.lit(0).alias("row_idx"), F.array(F.lit("状态码"), F.lit("描述")).alias("cells"))
    return body.unionByName(title).unionByName(head).unionByName(skipped)


FIELDS = f"""
WITH r AS ({ROWS}), f AS (
  SELECT doc_id, sheet, row_idx, c1 AS code, trim(regexp_replace(c2, '\\s+', ' ', 'g')) AS name, c3 AS field_type, c5 AS nullable, c6 AS default_value,
         CASE WHEN c4 <> '' THEN c4 WHEN c5 = '否' THEN 'Y' WHEN c5 = '是' THEN 'N' ELSE '' END AS required,
         CASE WHEN c4 <> '' THEN '由是否必填=' || c4 || '提供' WHEN c5 <> '' THEN '由允许空=' || c5 || '推导' ELSE '' END AS required_reason,
         starts_with(c1, '*') AS required_by_marker FROM r WHERE c1 <> '请求示例'),
g AS (SELECT *, required_by_marker AND required IN ('N', '否') AS required_mismatch, CASE WHEN default_value <> '' THEN 1 ELSE 0 END AS n_warnings FROM f)
"""


@query(FIELDS + "SELECT * FROM g")
def catalogue_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.fields(grids(spark, sf_dir))
    return out.select("doc_id", "sheet", "row_idx", "code", "name", "field_type", "nullable", "default_value", "required", "required_reason", "required_by_marker",
                      "required_mismatch", F.size("warnings").alias("n_warnings"))


@query(FIELDS + """SELECT doc_id, count(DISTINCT sheet) AS views, count(*) AS fields, CAST(sum(n_warnings) AS BIGINT) AS warnings,
  count(*) FILTER (ends_with(required_reason, '推导')) AS inferred_required FROM g GROUP BY 1""")
def catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.summary(catalogue.fields(grids(spark, sf_dir)))


@query("SELECT DISTINCT p_brand AS doc_id, 'S0' AS sheet, '非字段表，已跳过' AS diagnostic FROM part")
def catalogue_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.diagnostics(catalogue.with_inherited(catalogue.tables(grids(spark, sf_dir))))


CODES = ("patientId", "orderStatus", "visitSerial", "mysteryField", "Order_No", "RAW_DETAIL")
_CODE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
FEEDBACK = [("orderStatus", "order.status", 0.96, None, 0), ("RAW_DETAIL", "raw.old", 0.5, None, 1), ("raw_detail", "raw.detail", 0.8, "local", 2), ("mysteryField", " ", None, None, 3)]
MATCH = f"""
WITH f AS (SELECT p_partkey, {_CODE} AS code FROM part),
m AS (SELECT p_partkey, code,
  CASE code WHEN 'patientId' THEN 'patient.id' WHEN 'orderStatus' THEN 'order.status' WHEN 'visitSerial' THEN 'visit.identifier' WHEN 'Order_No' THEN 'order.no' WHEN 'RAW_DETAIL' THEN 'raw.detail' ELSE '' END AS candidate,
  CASE code WHEN 'patientId' THEN 0.98::DOUBLE WHEN 'orderStatus' THEN 0.96 WHEN 'visitSerial' THEN 0.62 WHEN 'Order_No' THEN 0.95 WHEN 'RAW_DETAIL' THEN 0.8 ELSE 0.0 END AS confidence,
  CASE WHEN code IN ('orderStatus', 'RAW_DETAIL') THEN 'local-feedback' WHEN code IN ('patientId', 'Order_No') THEN 'builtin-rule' WHEN code = 'visitSerial' THEN 'low-confidence-candidate' ELSE 'unmatched' END AS match_source,
  code IN ('visitSerial', 'mysteryField', 'RAW_DETAIL') AS needs_review FROM f)
"""


def _matches(spark, sf_dir):
    fields = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE).alias("code"), F.lit("").alias("name"), F.lit("").alias("json_path"), F.lit(None).cast("string").alias("description"))
    entries = spark.createDataFrame(FEEDBACK, "key string, candidate string, confidence double, reason string, seq int")
    return matching.match(fields, matching.feedback(entries), matching.rules(spark))


@query(MATCH + "SELECT * FROM m")
def field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("p_partkey", "code", "candidate", "confidence", "match_source", "needs_review")


@query(MATCH + """SELECT count(*) AS total, count(*) FILTER (match_source IN ('local-feedback', 'builtin-rule')) AS matched, count(*) FILTER (match_source = 'local-feedback') AS feedback,
  count(*) FILTER (match_source = 'low-confidence-candidate') AS low_confidence, count(*) FILTER (match_source = 'unmatched') AS unmatched, count(*) FILTER (needs_review) AS review FROM m""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.summary(_matches(spark, sf_dir))


#: A table per brand with parts of requests and responses: marker rows with a header, rows of fields, rows that name an interface.
SEGMENTED = """
SELECT p_brand AS doc_id, 'S1' AS sheet, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS row_idx,
       CASE p_size % 10 WHEN 0 THEN 'request' WHEN 5 THEN 'response' WHEN 9 THEN 'interface' END AS marker,
       CASE p_size % 10 WHEN 0 THEN '请求参数（加密前）' WHEN 5 THEN '返回结果' WHEN 9 THEN '接口名称' ELSE '' END AS c1,
       CASE p_size % 10 WHEN 0 THEN '参数名称' WHEN 5 THEN '参数名称' WHEN 9 THEN '/api' ELSE CASE WHEN p_partkey % 7 = 0 THEN 'n_type' ELSE replace(p_name, ' ', '_') END END AS c2,
       CASE p_size % 10 WHEN 0 THEN '必填' WHEN 5 THEN '必填' WHEN 9 THEN '' ELSE 'Y' END AS c3,
       CASE p_size % 10 WHEN 0 THEN '数据类型' WHEN 5 THEN '数据类型' WHEN 9 THEN '' ELSE 'string' END AS c4,
       CASE p_size % 10 WHEN 0 THEN '描述' WHEN 5 THEN '描述' WHEN 9 THEN '' ELSE concat('固定格式:', upper(replace(p_type, ' ', '_'))) END AS c5 FROM part"""


@query(f"""WITH r AS ({SEGMENTED}), s AS (
  SELECT *, count(marker) OVER w AS segment, last_value(CASE WHEN marker <> 'interface' THEN marker END IGNORE NULLS) OVER w AS part,
         last_value(marker IGNORE NULLS) OVER w AS opened FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx ROWS UNBOUNDED PRECEDING)),
f AS (SELECT * FROM s WHERE marker IS NULL AND opened IN ('request', 'response')),
h AS (SELECT doc_id, segment, arg_min(regexp_extract(c5, '[A-Z][A-Z0-9_]{{3,}}'), row_idx) FILTER (c2 = 'n_type') AS hint FROM f GROUP BY 1, 2),
t AS (SELECT doc_id, segment, coalesce(last_value(hint IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY segment ROWS UNBOUNDED PRECEDING), '') AS interface_title FROM h)
SELECT doc_id, sheet, segment, row_idx, part, c2 AS code, part || '.' || c2 AS json_path, interface_title FROM f JOIN t USING (doc_id, segment)""")
def segment_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(SEGMENTED.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    out = catalogue.segment_fields(rows.select("doc_id", "sheet", "row_idx", F.array("c1", "c2", "c3", "c4", "c5").alias("cells")))
    return out.select("doc_id", "sheet", "segment", "row_idx", "part", "code", "json_path", "interface_title")


_COUNTED = ", ".join(f"'- {name}: `' || {c} || '`'" for name, c in matching.REPORT_COUNTS)


@query(MATCH + f""", d AS (SELECT p_brand AS doc_id, CAST(p_size % 5 AS VARCHAR) AS sheet, p_partkey AS row_idx, m.*, CASE match_source WHEN 'unmatched' THEN '未找到可靠通用规则或项目本地反馈' ELSE 'r' END AS reason FROM m JOIN part USING (p_partkey)),
n AS (SELECT doc_id, count(*) AS total, count(*) FILTER (match_source IN ('local-feedback', 'builtin-rule')) AS matched, count(*) FILTER (match_source = 'local-feedback') AS feedback,
  count(*) FILTER (match_source = 'low-confidence-candidate') AS low_confidence, count(*) FILTER (match_source = 'unmatched') AS unmatched, count(*) FILTER (needs_review) AS review FROM d GROUP BY 1),
l AS (
  SELECT doc_id, 0 AS part, NULL::VARCHAR AS sheet, -2::BIGINT AS "at", ['# Field Match', '', '## 字段匹配摘要', '', '- document: `' || doc_id || '`', {_COUNTED}, '', '## 匹配结果', ''] AS ls FROM n
  UNION ALL SELECT DISTINCT doc_id, 1, sheet, -1, ['### ' || sheet, '', '| {' | '.join(matching.REPORT_COLUMNS)} |', '|{' --- |' * 7}'] FROM d
  UNION ALL SELECT DISTINCT doc_id, 1, sheet, 4611686018427387904, [''] FROM d
  UNION ALL SELECT doc_id, 1, sheet, row_idx, ['| ' || code || ' |  | ' || candidate || ' | ' || confidence || ' | ' || match_source || ' | ' || CASE WHEN needs_review THEN 'Y' ELSE 'N' END || ' | ' || reason || ' |'] FROM d
  UNION ALL SELECT doc_id, 2, NULL, -2, CASE WHEN review > 0 THEN ['## 需人工确认', ''] ELSE ['## 需人工确认', '', '- 暂无。'] END FROM n
  UNION ALL SELECT doc_id, 2, sheet, row_idx, ['- `' || code || '`: ' || reason] FROM d WHERE needs_review
  UNION ALL SELECT doc_id, 3, NULL, -2, CASE WHEN unmatched > 0 THEN ['', '## 未匹配字段', ''] ELSE ['', '## 未匹配字段', '', '- 暂无。'] END FROM n
  UNION ALL SELECT doc_id, 3, sheet, row_idx, ['- `' || code || '` '] FROM d WHERE match_source = 'unmatched')
SELECT doc_id, part, sheet, "at", CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line FROM l""")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("doc_id"), (F.col("p_size") % 5).cast("string").alias("sheet"), F.col("p_partkey").alias("row_idx"))
    matches = _matches(spark, sf_dir).join(p, "p_partkey").withColumn("reason", F.when(F.col("match_source") == "unmatched", F.col("reason")).otherwise("r"))
    return matching.report(matches).withColumn("at", F.coalesce("at", F.lit(-2)))  # null in the report's other lines


_TOLD = ", ".join(f"'- {label}: `' || coalesce({c}, 0) || '`'" for label, c in (("views", "views"), ("fields", "fields"), ("fieldWarnings", "warned"), ("lowConfidenceFields", "0"), ("inferredRequiredFields", "inferred")))


@query(FIELDS + f""", n AS (SELECT doc_id, count(DISTINCT sheet) AS views, count(*) AS fields, CAST(sum(n_warnings) AS BIGINT) AS warned, count(*) FILTER (ends_with(required_reason, '推导')) AS inferred FROM g GROUP BY 1),
l AS (SELECT doc_id, ['# Diagnostics', '', '- converter: `built-in`', {_TOLD}, '', '## Notes', '', '- 非字段表，已跳过'] AS ls FROM (SELECT DISTINCT p_brand AS doc_id FROM part) LEFT JOIN n USING (doc_id))
SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INTEGER) AS line_no, unnest(ls) AS line FROM l""")
def diagnostics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grids(spark, sf_dir)
    return catalogue.diagnostics_report(catalogue.fields(g), catalogue.diagnostics(catalogue.with_inherited(catalogue.tables(g))))
