"""Section context, reports, update summaries and the manifest rules on nested entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import catalogue, keyed, manifest, updates
from fieldloom.plans.catalogue_queries import FIELDS, grids
from fieldloom.plans.registry import query
from fieldloom.shared import table
from fieldloom.sources import texts

#: Lines of interface documents, in words that Spark and DuckDB share: a document per brand.
LINES = """
SELECT p_brand AS doc_id, p_partkey AS line_no, CASE p_partkey % 12 WHEN 0 THEN concat('3.', CAST(p_size AS VARCHAR(9)), '  查询', p_type, '接口') WHEN 1 THEN concat('3.', CAST(p_size AS VARCHAR(9)))
  WHEN 2 THEN concat(p_type, '接口') WHEN 3 THEN concat('3.', CAST(p_size AS VARCHAR(9)), '.2 返回', p_name) WHEN 4 THEN '请求参数' WHEN 5 THEN 'Data_x 参数' WHEN 6 THEN '响应 消息说明'
  WHEN 7 THEN concat('3.9 目录接口 ..... ', CAST(p_size AS VARCHAR(9))) WHEN 8 THEN '' WHEN 9 THEN concat('3.', CAST(p_size AS VARCHAR(9)), '.4', p_name) WHEN 10 THEN '公共请求头' ELSE p_name END AS line FROM part"""


@query(f"""WITH r AS ({LINES}),
l AS (SELECT doc_id, line_no, line LIKE '%...%' AS toc, trim(regexp_replace(regexp_replace(line, '\\.{{3,}}.*$', ''), '\\s+', ' ', 'g')) AS line FROM r),
k AS (SELECT * FROM l WHERE line <> ''),
n AS (SELECT *, list_filter(list_reverse(list(line) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  lambda x: ends_with(x, '接口') AND NOT regexp_matches(x, '^[0-9]') AND x <> '接口说明')[1] AS near FROM k),
f AS (SELECT *, NOT toc AND regexp_matches(line, '^3\\.[0-9]+\\s+.+接口$') AS direct, NOT toc AND regexp_matches(line, '^3\\.[0-9]+$') AS alone,
  NOT toc AND regexp_matches(line, '^3\\.[0-9]+\\.[0-9]+\\s*\\S') AS inn, replace(lower(line), ' ', '') AS bare FROM n),
o AS (SELECT *, direct OR (alone AND near IS NOT NULL) AS opened FROM f),
s AS (SELECT *, CASE WHEN opened THEN regexp_extract(line, '^(3\\.[0-9]+)', 1) END AS ino,
  CASE WHEN direct THEN regexp_extract(line, '^3\\.[0-9]+\\s+(.+)$', 1) WHEN opened THEN near END AS ititle,
  CASE WHEN opened THEN '' WHEN inn THEN regexp_extract(line, '^(3\\.[0-9]+\\.[0-9]+)\\s*(.+?)$', 1) END AS sno,
  CASE WHEN opened THEN '' WHEN inn THEN regexp_extract(line, '^(3\\.[0-9]+\\.[0-9]+)\\s*(.+?)$', 2) END AS stitle,
  CASE WHEN toc OR opened OR alone THEN NULL WHEN regexp_matches(line, '^[A-Za-z_][A-Za-z0-9_]*\\s*参数$') THEN regexp_extract(line, '^([A-Za-z_][A-Za-z0-9_]*)', 1)
    WHEN bare LIKE '%公共请求头%' THEN 'headers' WHEN bare LIKE '%请求参数%' THEN 'request' WHEN bare LIKE '%响应消息说明%' THEN 'response'
    WHEN inn AND contains(line, '返回') THEN 'response' END AS part FROM o)
SELECT doc_id, line_no, line, coalesce(last_value(ino IGNORE NULLS) OVER w, '') AS interface_no, coalesce(last_value(ititle IGNORE NULLS) OVER w, '') AS interface_title,
  coalesce(last_value(sno IGNORE NULLS) OVER w, '') AS subsection_no, coalesce(last_value(stitle IGNORE NULLS) OVER w, '') AS subsection_title, coalesce(last_value(part IGNORE NULLS) OVER w, '') AS part
FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)""")
def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.sql(LINES.replace("FROM part", "FROM {p}"), p=table(spark, sf_dir, "part"))
    return catalogue.section_context(lines)


@query(FIELDS + """SELECT doc_id, sheet, row_idx, '|  | ' || code || ' | ' || name || ' | ' || field_type || ' |  | ' || required || ' | ' || nullable || ' |  | ' || default_value || ' | ' ||
  CASE WHEN required_by_marker THEN '*' ELSE '' END || CASE WHEN required_mismatch THEN ' mismatch' ELSE '' END || ' |  | ' || CASE WHEN n_warnings > 0 THEN 'defaultValue:需要人工确认默认值语义' ELSE '' END || ' |' AS line FROM g""")
def field_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.field_report(catalogue.fields(grids(spark, sf_dir)))


@query(FIELDS + "SELECT doc_id, count(*) AS fields, count(DISTINCT sheet) AS views, count(*) FILTER (required = 'Y') AS required FROM g GROUP BY 1")
def parsed_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = catalogue.parsed_envelope(catalogue.fields(grids(spark, sf_dir)))
    kind = "doc_id string, view_count long, views array<struct<sheet:string,fields:array<struct<row_idx:int,required:string>>>>"
    v = F.from_json("json", kind)
    fields = F.flatten(F.transform(v["views"], lambda x: x["fields"]))
    return out.select("doc_id", F.size(fields).cast("long").alias("fields"), v["view_count"].alias("views"), F.size(F.filter(fields, lambda f: f["required"] == "Y")).cast("long").alias("required"))


@query("""SELECT p_brand AS doc_id, CAST(p_partkey AS VARCHAR) AS sheet, p_name || '（' || p_type || '）' AS title FROM part WHERE p_size % 3 = 0
UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), p_name FROM part WHERE p_size % 3 = 1""")
def interface_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    row = lambda i, label, value: F.struct(F.lit(i).alias("row_idx"), F.array(F.lit(label), value).alias("cells"))
    rows = F.when(F.col("p_size") % 3 == 0, F.array(row(0, "接口", F.lit("接口")), row(1, "名称", F.col("p_name")), row(2, " 功能描述 ", F.col("p_type")), row(3, "name", F.lit("later"))))
    rows = rows.when(F.col("p_size") % 3 == 1, F.array(row(0, "Name", F.col("p_name")), row(7, "功能描述", F.lit("")))).otherwise(F.array(row(0, "description", F.col("p_type")), row(1, "名称", F.lit("名称"))))
    g = p.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").cast("string").alias("sheet"), F.explode(rows).alias("r")).select("doc_id", "sheet", "r.*")
    return catalogue.interface_titles(g)


@query("""WITH r AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN ['接口 名称', p_name] WHEN 1 THEN ['1', '请求参数（加密前）'] WHEN 2 THEN ['(返回', '结果)'] WHEN 3 THEN ['出参', '接口名称'] ELSE [p_name] END AS c FROM part),
t AS (SELECT p_partkey, lower(regexp_replace(array_to_string(c, ''), '[\\s（）()]+', '', 'g')) AS t FROM r)
SELECT p_partkey, t AS row_text, CASE WHEN contains(t, '接口名称') THEN 'interface' WHEN contains(t, '请求参数') THEN 'request' WHEN contains(t, '返回结果') OR contains(t, '出参') THEN 'response' END AS marker FROM t""")
def row_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.expr("CASE p_size % 5 WHEN 0 THEN array('接口 名称', p_name) WHEN 1 THEN array('1', '请求参数（加密前）') WHEN 2 THEN array('(返回', '结果)') WHEN 3 THEN array('出参', '接口名称') ELSE array(p_name) END")
    return table(spark, sf_dir, "part").select("p_partkey", T.row_text(c).alias("row_text"), catalogue.row_marker(c).alias("marker"))


@query("""SELECT p_brand AS doc_id, CAST(p_size AS VARCHAR) AS sheet, arg_min(regexp_extract('类型' || replace(upper(p_type), ' ', '') || '_X', '[A-Z][A-Z0-9_]{3,}'), p_partkey) AS hint
FROM part WHERE p_partkey % 3 = 0 GROUP BY 1, 2""")
def interface_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("string").alias("sheet"), F.col("p_partkey").alias("row_idx"), F.when(F.col("p_partkey") % 3 == 0, "*N_Type").otherwise("code").alias("code"),
                    F.concat(F.lit("类型 "), F.upper("p_type")).alias("name"), F.lit("_X").alias("description"))
    return catalogue.interface_hints(rows)


_RESULTS = """SELECT l_orderkey AS seq, concat('p', CAST(l_suppkey % 7 AS VARCHAR(9))) AS plugin, l_returnflag AS target, CASE l_partkey % 8 WHEN 0 THEN 'config-missing-key' WHEN 1 THEN 'config-merged-key'
  WHEN 2 THEN 'config-deprecated-candidate' WHEN 3 THEN 'config-review-required' WHEN 4 THEN 'config-created' WHEN 5 THEN 'config-missing-file' WHEN 6 THEN 'ok' END AS status,
  CASE WHEN l_linenumber = 1 THEN 'upload' ELSE 'compile' END AS phase FROM lineitem"""


def _results(spark, sf_dir):
    return spark.sql(_RESULTS.replace("FROM lineitem", "FROM {l}"), l=table(spark, sf_dir, "lineitem"))


@query(f"WITH r AS ({_RESULTS}) SELECT plugin, target, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {n}" for n, s in updates.CONFIG.items())
       + " FROM r WHERE starts_with(status, 'config-') GROUP BY 1, 2")
def config_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.config_notes(_results(spark, sf_dir))


@query(f"WITH r AS ({_RESULTS}) SELECT status, count(*) AS n FROM r GROUP BY 1")
def update_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.status_summary(_results(spark, sf_dir), ["config-review-required"])[0]


@query(f"""WITH r AS ({_RESULTS}) SELECT phase, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status IS DISTINCT FROM 'ok') AS failed, count(*) AS total,
  bool_or(status IS DISTINCT FROM 'ok') AS any_failed FROM r GROUP BY 1""")
def phase_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return updates.phase_totals(_results(spark, sf_dir))


@query("""SELECT 'INSERT INTO terms (code, name) VALUES (''' || c_custkey || ''', ' || CASE WHEN c_custkey % 5 = 0 THEN 'NULL' ELSE '''' || replace(c_name || '''s', '''', '''''') || '''' END || ')' AS statement FROM customer""")
def insert_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.when(F.col("c_custkey") % 5 != 0, F.concat("c_name", F.lit("'s"))).alias("name"))
    return updates.insert_statements(c, "terms", ["code", "name"])


@query("""
WITH t AS (SELECT p_brand AS file, p_type AS text, CASE WHEN p_size % 7 = 0 THEN ' ' WHEN p_size % 7 = 1 THEN NULL ELSE p_name || '|' || p_partkey END AS translation, 'size ' || p_size AS note FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY file, text ORDER BY coalesce(trim(translation) = '', true), translation NULLS FIRST, note NULLS FIRST) AS n FROM t)
SELECT '| ' || coalesce(replace(file, '|', '\\|'), '') || ' |  | backend-dict | ' || coalesce(replace(text, '|', '\\|'), '') || ' |  | ' || coalesce(replace(translation, '|', '\\|'), '') || ' | '
  || coalesce(replace(note, '|', '\\|'), '') || ' |' AS line FROM b WHERE n = 1""")
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("p_size") % 7 == 0, " ").when(F.col("p_size") % 7 != 1, F.concat("p_name", F.lit("|"), F.col("p_partkey").cast("string")))
    terms = table(spark, sf_dir, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("text"), F.lit(None).cast("string").alias("meaning"), said.alias("translation"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("note"))
    return updates.term_table(terms).select(T.markdown_row(F.array(*[f"`{c}`" for c in updates.TERMS]), len(updates.TERMS)).alias("line"))


@query("""SELECT CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE 0 END AS error_code,
  CASE WHEN c_custkey % 4 = 0 THEN 'missing parameters: c_name' END AS error FROM customer""")
def parameter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_name END").alias("c_name"))
    return keyed.checked_parameters(c, ["c_custkey", "c_name"])


# --- manifests ------------------------------------------------------------------------------

#: Entries of runs, in words that both engines share; an order is a run.
_VERSION = "CASE o_orderkey % 4 WHEN 0 THEN '1.0' WHEN 1 THEN '1.1' ELSE '1.2' END"
ACTIONS = f"""SELECT o_orderkey AS run_id, {_VERSION} AS version, o_orderpriority AS type, o_orderkey % 3 = 0 AS `write`, o_orderkey % 5 <> 0 AS authorized, o_orderkey % 7 <> 0 AS run_authorized,
  CASE WHEN o_custkey % 6 = 0 THEN ' ' ELSE 'local' END AS scope, CASE o_custkey % 4 WHEN 0 THEN 'business-code-deploy' WHEN 1 THEN 'translation-data-write' WHEN 2 THEN 'odd' END AS category,
  CASE o_custkey % 5 WHEN 0 THEN 'planned' WHEN 1 THEN 'completed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'lost' END AS state, o_orderstatus = 'F' AS terminal, o_orderkey % 2 = 0 AS ready FROM orders"""
GATES = """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN 'fail' ELSE 'pass' END AS handoff, CASE WHEN o_orderkey % 7 <> 0 THEN 'PASS' END AS sensitive,
  CASE o_orderkey % 4 WHEN 0 THEN 'pass' WHEN 1 THEN 'not-authorized' WHEN 2 THEN 'other' ELSE 'not-applicable' END AS compile, CASE WHEN o_custkey % 2 = 0 THEN 'pass' END AS structure,
  CASE WHEN o_custkey % 3 = 0 THEN 'low' ELSE '' END AS residual_risk, o_custkey % 2 = 0 AS xml_triggered, o_custkey % 5 AS x FROM orders"""
FINALS = """SELECT o_orderkey AS run_id, o_orderkey % 5 <> 0 AS ready, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS checked, o_orderkey AS verified FROM orders"""
FAILURES = """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS signature, CASE WHEN o_custkey % 2 = 0 THEN 'payload-compilation' ELSE 'network' END AS category,
  CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 4 END AS retries, o_orderkey % 3 = 0 AS historical, CASE WHEN o_orderkey % 5 = 0 THEN 'lost log' ELSE '' END AS unknown_reason, 'none' AS fallback, 'ended' AS result,
  o_orderkey % 2 = 0 AS retrospective FROM orders"""


def _orders(spark, sf_dir, sql):
    return spark.sql(sql.replace("FROM orders", "FROM {o}"), o=table(spark, sf_dir, "orders"))


def _duck(sql, checks):
    """The issues of a table in DuckDB: (rule, subject, message, condition)."""
    return f"WITH t AS ({sql.replace('`', chr(34))}) " + " UNION ALL ".join(
        f"SELECT run_id, '{rule}' AS rule, CAST({subject} AS VARCHAR) AS subject, '{message}' AS message FROM t WHERE {wrong}" for rule, subject, message, wrong in checks)


@query(_duck(ACTIONS, [
    ("J13", "type", "write is not authorised", '"write" AND NOT (authorized AND run_authorized)'),
    ("J13", "type", "write without scope", "version <> '1.0' AND \"write\" AND trim(scope) = ''"),
    ("J13", "type", "write without a known category", f"version <> '1.0' AND \"write\" AND coalesce(category, '') NOT IN {manifest.CATEGORIES}"),
    ("J13", "type", "unknown state", f"version = '1.2' AND coalesce(state, '') NOT IN {manifest.REMOTE_STATES}"),
    ("J13", "type", "state and terminal flag differ", f"version = '1.2' AND (coalesce(state, '') IN {manifest.REMOTE_ENDS}) <> terminal"),
    ("J13", "type", "ready before the action ended", "version = '1.2' AND ready AND NOT terminal")]))
def manifest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.action_issues(_orders(spark, sf_dir, ACTIONS))


@query(_duck(GATES, [
    ("J15", "'handoff'", "gate is not passed", "handoff <> 'pass'"), ("J15", "'sensitive'", "gate is not passed", "sensitive IS NULL"),
    ("J15", "'compile'", "unknown result", "compile = 'other'"), ("J15", "'structure'", "not compiled and structure not checked", "compile = 'not-authorized' AND structure IS NULL"),
    ("J15", "'residual_risk'", "not compiled and no risk given", "compile = 'not-authorized' AND residual_risk = ''"), ("J15", "'xml'", "gate is not passed", "xml_triggered AND x < 2")]))
def manifest_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    xml = F.expr("CASE x WHEN 0 THEN array('pass', 'pass', 'pass') WHEN 1 THEN array('pass', 'pass', 'fail', 'pass') ELSE array('pass', 'PASS', 'pass', 'pass') END")
    return manifest.gate_issues(_orders(spark, sf_dir, GATES).withColumn("xml", xml))


@query(_duck(FINALS, [("J12", "'ready'", "not ready", "NOT ready"), ("J12", "'checked'", "check time is missing", "checked IS NULL"),
                      ("J12", "'checked'", "checked after the verifier''s start", "checked > verified")]))
def manifest_finals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.finalization_issues(_orders(spark, sf_dir, FINALS))


@query(_duck(FAILURES, [
    ("J14", "coalesce(signature, '')", "record is incomplete", "signature IS NULL"),
    ("J14", "coalesce(signature, '')", "retry count is missing", "retries IS NULL AND NOT (retrospective AND historical AND unknown_reason <> '')"),
    ("J14", "coalesce(signature, '')", "retried more than once", "category = 'payload-compilation' AND retries > 1 AND NOT (retrospective AND historical)")]))
def manifest_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.failure_issues(_orders(spark, sf_dir, FAILURES))


@query(f"""WITH t AS (SELECT o_orderkey AS run_id, o_orderkey > o_custkey * 9 AS late, CASE o_orderkey % 4 WHEN 0 THEN {list(manifest.SCOPES)} WHEN 1 THEN ['business-code'] WHEN 2 THEN ['local-i18n-artifacts', 'x', 'business-code', 'authorized-remote-readback'] ELSE [] END AS c FROM orders)
SELECT run_id, 'J11' AS rule, array_to_string(list_sort(list_filter({list(manifest.SCOPES)}, lambda s: NOT list_contains(c, s))), ',') AS subject, 'scope was not checked' AS message FROM t WHERE len(list_filter({list(manifest.SCOPES)}, lambda s: NOT list_contains(c, s))) > 0
UNION ALL SELECT run_id, 'J11', 'x', 'scope is not supported' FROM t WHERE list_contains(c, 'x')
UNION ALL SELECT run_id, 'J11', 'mutated', 'changed after the verifier''s start' FROM t WHERE late""")
def manifest_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = ", ".join(f"'{s}'" for s in manifest.SCOPES)
    checked = F.expr(f"CASE o_orderkey % 4 WHEN 0 THEN array({full}) WHEN 1 THEN array('business-code') WHEN 2 THEN array('local-i18n-artifacts', 'x', 'business-code', 'authorized-remote-readback') ELSE array() END")
    return manifest.scope_issues(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), checked.alias("checked"), F.col("o_orderkey").alias("mutated"), (F.col("o_custkey") * 9).alias("verified")))


@query(f"""WITH t AS (SELECT o_orderkey AS run_id, {_VERSION} AS v FROM orders),
w AS (SELECT run_id, unnest({list(manifest.KEYS)} || CASE v WHEN '1.1' THEN {list(manifest.KEYS_OF['1.1'])} WHEN '1.2' THEN {list(manifest.KEYS_OF['1.2'])} ELSE [] END) AS k FROM t)
SELECT run_id, 'J1' AS rule, k AS subject, 'required key is missing' AS message FROM w WHERE k NOT IN ('topic', 'stages', 'ownership') OR (k = 'stages' AND run_id % 3 = 0)""")
def manifest_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN array('topic', 'ownership', 'more') ELSE array('stages', 'topic', 'ownership') END")
    return manifest.key_issues(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.expr(_VERSION).alias("version"), keys.alias("keys")))


@query(r"""WITH c AS (SELECT doc_id AS run_id, unnest(list_filter([
  CASE WHEN regexp_matches(text, '(^|[^0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}([^0-9]|$)') THEN 'IPv4 address' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:https?|sftp)://') THEN 'network URL' END,
  CASE WHEN regexp_matches(text, '(?i)\b[A-Z]:\\') THEN 'Windows absolute path' END,
  CASE WHEN regexp_matches(text, '(?i)(?:^|[\s"''`])/(?:opt|var|home|usr|srv)/') THEN 'server absolute path' END,
  CASE WHEN regexp_matches(text, '(?im)\b(?:password|passwd|token|secret|account|username|namespace|remotePath)\b\s*[:=]\s*["'']?[^"''\s,}]+') THEN 'secret or connection assignment' END,
  CASE WHEN regexp_matches(text, '(?m)[A-Za-z0-9+/]{256,}={0,2}') THEN 'long Base64 payload' END,
  CASE WHEN regexp_matches(text, '(?i)<\?xml\s') THEN 'complete XML payload' END], lambda x: x IS NOT NULL)) AS class FROM documents)
SELECT run_id, 'J17' AS rule, 'text' AS subject, 'contains prohibited ' || class AS message FROM c""")
def manifest_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.redaction_issues(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("run_id"), F.lit("text").alias("name"), F.col("text").alias("content")))


# --- structured text ------------------------------------------------------------------------

@query("""SELECT c_custkey, 'name' AS name, c_name || ' of ' || c_nationkey AS value FROM customer UNION ALL SELECT c_custkey, 'kind', c_mktsegment FROM customer""")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("---\nname: "), "c_name", F.lit("\n  of "), F.col("c_nationkey").cast("string"), F.lit("\nkind: "), "c_mktsegment", F.lit("\nother: x\n---\nname: body\n"))
    lines = texts.lines(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")
    return texts.front_matter_fields(texts.front_matter(lines, "c_custkey"), "c_custkey", ["name", "kind"])


@query("""SELECT c_custkey, 'name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'market', c_mktsegment FROM customer""")
def setting_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# x\n- name: "), "c_name", F.lit("\n - market： "), "c_mktsegment", F.lit(" \n- name: second\nnot: this\n"))
    return texts.settings(texts.lines(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text"), "c_custkey")


@query("""SELECT c_custkey, CAST(0 AS INTEGER) AS line_no, c_name || ';' || c_mktsegment || ';' AS cells FROM customer UNION ALL SELECT c_custkey, 2, 'a;' || c_nationkey FROM customer""")
def pipe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" | |\n| --- | :-: | ---: |\n| a | "), F.col("c_nationkey").cast("string"), F.lit("|\nno | row\n| one |"))
    out = texts.pipe_rows(texts.lines(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text"), "c_custkey")
    return out.withColumn("cells", F.array_join("cells", ";"))


@query("""SELECT c_custkey, 0 AS block, 'Name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 1, 'state', c_mktsegment FROM customer""")
def status_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("Name : "), "c_name", F.lit("\n-- no\n\n state: "), "c_mktsegment", F.lit(" "))
    return texts.status_blocks(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text")


@query("""SELECT event_id, event_type || 'A,k' || user_id AS names, starts_with(event_type, 'c') AS cjk, event_id % 2 = 0 AS xml, 'a,b' AS shown, 'X ' || event_type AS language,
  CASE WHEN event_type IN ('view', 'click') THEN false ELSE true END AS other, 'p:1+p:3' AS kept, 'head' || chr(10) || 'tail' AS rest FROM events""")
def text_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    deep = F.concat(F.lit('{"a": [{"PrintTemp": "'), "event_type", F.lit('A", "x": {"printtemp": "k'), F.col("user_id").cast("string"), F.lit('"}}, {"PrintTemp": "'), F.upper("event_type"), F.lit('a"}]}'))
    xml = F.when(F.col("event_id") % 2 == 0, F.lit("<a><b c='1'/></a>")).otherwise(F.lit("<a><b></a>"))
    block = F.lit("head\nStorage Default\n{\nx\n{\n}\n}\ntail")
    return e.select("event_id", F.array_join(T.key_values("PrintTemp")(deep), ",").alias("names"), T.has_cjk(F.when(F.col("event_type").startswith("c"), F.lit("中")).otherwise(F.lit("é"))).alias("cjk"),
                    T.is_well_formed_xml(xml).alias("xml"), F.array_join(F.transform(T.forbidden_lines(F.lit("a!\nc\nb!"), "!"), lambda s: F.replace(s["line"], F.lit("!"), F.lit(""))), ",").alias("shown"),
                    F.concat(F.lit("X "), F.lower(T.language_name(F.col("event_type"), {}))).alias("language"), T.not_in(F.col("event_type"), ["view", "click"]).alias("other"),
                    T.prefixed_texts(F.array(F.lit("1"), F.lit(""), F.lit("3")), lambda x: x != "", "p:", "+").alias("kept"), T.without_block(block, "Storage Default").alias("rest"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts END AS moment FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    shown = F.when(F.col("event_id") % 3 == 0, F.concat(text, F.lit("Z"))).when(F.col("event_id") % 3 == 1, text).otherwise(F.lit("soon"))
    return table(spark, sf_dir, "events").select("event_id", T.iso_time(shown).cast("timestamp_ntz").alias("moment"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'external' WHEN l_linestatus = 'F' THEN 'dictionary' WHEN l_linenumber = 1 THEN 'unconfirmed' ELSE 'fixed' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN 'keep' WHEN l_linestatus = 'F' THEN 'map' WHEN l_linenumber = 1 THEN 'confirm' ELSE 'translate' END AS action FROM lineitem""")
def text_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, action = T.text_class(F.when(F.col("l_linenumber") != 1, F.col("l_linestatus")), F.col("l_linestatus") == "F", F.col("l_returnflag") == "R", F.lit(False))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("kind"), action.alias("action"))


@query("""SELECT c_custkey, 'name' AS name, 0 AS at, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'tags', 1, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'tags', 2, 'x y' FROM customer""")
def yaml_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("# head\nname: '"), "c_name", F.lit("'  # said\ntags:\n  - "), "c_mktsegment", F.lit("\n  - \"x y\"\nempty:\nname: again\n"))
    return texts.yaml_values(texts.lines(table(spark, sf_dir, "customer").select("c_custkey", text.alias("text")), "c_custkey", "text"), "c_custkey")


@query("""SELECT event_id, CASE WHEN event_id % 3 <> 1 THEN props END AS object FROM events""")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("CASE event_id % 3 WHEN 0 THEN concat('\ufeff', props) WHEN 1 THEN concat('[', props, ']') ELSE props END")
    return table(spark, sf_dir, "events").select("event_id", texts.json_object(text).alias("object"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'own;' ELSE '' END || CASE WHEN o_orderstatus <> 'F' THEN 'not connected: probe before relying on it' WHEN o_custkey % 2 = 0 THEN
  'looks like the defaults: verify the target' ELSE '' END AS said FROM orders""")
def connection_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = F.struct(F.when(F.col("o_orderkey") % 2 == 0, " own ").alias("fallback_warning"), (F.col("o_orderstatus") == "F").alias("connected"), F.lit("").alias("config_file"),
                     F.when(F.col("o_custkey") % 4 == 0, "USER").otherwise("APP").alias("namespace"), F.when(F.col("o_custkey") % 4 == 2, 52773).otherwise(1).alias("port"))
    said = T.connection_warnings(check)
    own = F.when(F.array_contains(said, "own"), "own;").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat(own, F.array_join(F.array_remove(said, "own"), "")).alias("said"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'headers.f' WHEN 2 THEN 'data.order.f' ELSE '' END AS path, CASE WHEN p_size % 2 = 0 THEN 'x_1' ELSE '' END AS code,
  CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 27 ELSE 2 END AS at, p_size % 3 = 0 AS temporary FROM part""")
def field_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    context = F.when(size % 4 == 0, "").when(size % 4 == 1, "headers").when(size % 4 == 2, "order")
    return table(spark, sf_dir, "part").select(
        "p_partkey", T.json_path(F.lit("**f"), context).alias("path"), T.field_code(F.when(size % 2 == 0, " **x_1 ").otherwise("*")).alias("code"),
        T.column_index(F.when(size % 3 == 0, "7").when(size % 3 == 1, "AB12").otherwise("c")).alias("at"),
        T.temporary_failure(F.when(size % 3 == 0, "Execute+9^x <SYNTAX>").when(size % 3 == 1, "Execute+9\n<SYNTAX>")).alias("temporary"))
