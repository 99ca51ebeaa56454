"""Log analytics over ``events``, read as application log messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.operators import intervals, slow_calls, traces
from fieldloom.plans.registry import query
from fieldloom.shared import table

MODULES = ("his.ipcare", "his.opcare", "his.insu", "hos", "his.ph", "his.zzz", "his.lisx", "his.emcare")
ROOT = "vendor"
#: The messages, in words that Spark and DuckDB share. One in eleven has no duration, one in thirteen no interface.
_CASES = " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(MODULES))
MESSAGES = f"""
SELECT event_id AS seq,
       CASE WHEN event_id % 13 = 0 THEN 'no marker' ELSE
         concat('接口[com.vendor.', CASE user_id % {len(MODULES)} {_CASES} END, '.Api#', event_type, '(x', CAST(user_id AS VARCHAR(20)), ')]',
                CASE WHEN event_id % 11 = 0 THEN '' ELSE concat(' 耗时：', CAST(event_id * 7919 % 90000 AS VARCHAR(20)), 'ms') END) END AS full_message,
       concat('t', CAST(user_id AS VARCHAR(20))) AS "traceId", CAST(event_id AS VARCHAR(20)) AS "timestamp", user_id, event_type, ts
FROM events"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES.replace('"', "`").replace("FROM events", "FROM {e}"), e=table(spark, sf_dir, "events"))


_GROUPS = " ".join(f"WHEN starts_with(module, '{p}') THEN '{g}'" for p, g, _ in slow_calls.PRODUCT_GROUPS)
CALLS = f"""
WITH m AS ({MESSAGES}),
c AS (
  SELECT seq, "traceId" AS trace_id, "timestamp" AS t, split_part(regexp_extract(full_message, '接口\\[(.+?)\\]', 1), '(', 1) AS full_name,
         coalesce(TRY_CAST(regexp_extract(full_message, '耗时[：:]\\s*([0-9]+)', 1) AS BIGINT), 0) AS ms
  FROM m WHERE regexp_matches(full_message, '接口\\[.+?\\]')),
g AS (
  SELECT full_name, count(*) AS calls, max(ms) AS max_ms, sum(ms) / count(*) AS mean_ms, min(seq) AS first_seq,
         arg_max(trace_id, ms * 10000000000 - seq) AS tr, arg_max(t, ms * 10000000000 - seq) AS tt FROM c GROUP BY full_name),
p AS (
  SELECT *, regexp_extract(full_name, '[^.]*$') AS short_name,
         CASE WHEN full_name LIKE 'com.vendor.his.%' THEN split_part(full_name, '.', 4) ELSE split_part(full_name, '.', 3) END AS module FROM g),
s AS (
  SELECT full_name, short_name, CASE {_GROUPS} ELSE '{slow_calls.OTHER}' END AS product_group, calls, max_ms,
         CASE WHEN max_ms > 0 THEN tr ELSE '' END AS max_trace, CASE WHEN max_ms > 0 THEN tt END AS max_ts, mean_ms,
         CASE WHEN max_ms > 60000 THEN 'high' WHEN max_ms > 30000 THEN 'mid' ELSE 'low' END AS severity, first_seq FROM p)
"""


def _stats(spark, sf_dir):
    return slow_calls.stats(slow_calls.calls(messages(spark, sf_dir)), ROOT)


@query(CALLS + "SELECT * FROM s")
def slow_call_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@query(CALLS + """SELECT full_name, max_ms, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY max_ms DESC, first_seq) AS rank FROM s) WHERE rank <= 20""")
def slow_call_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.ranked(_stats(spark, sf_dir), 20).select("full_name", "max_ms", "rank")


@query(CALLS + "SELECT product_group, count(*) AS interfaces, CAST(sum(calls) AS BIGINT) AS calls, max(max_ms) AS worst_ms FROM s GROUP BY 1")
def slow_call_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.by_group(_stats(spark, sf_dir))


@query(CALLS + "SELECT count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'mid') AS mid, count(*) FILTER (severity = 'low') AS low FROM s")
def slow_call_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.severities(_stats(spark, sf_dir))


@query(CALLS + "SELECT (SELECT count(*) FROM m) AS total, (SELECT count(*) FROM m) AS sampled, count(DISTINCT full_name) AS interfaces FROM c")
def slow_call_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.envelope(messages(spark, sf_dir))


@query(CALLS + """SELECT full_name, CAST(seq // 1000 AS BIGINT) AS part, '[' || string_agg(ms, ', ' ORDER BY seq) || ']' AS durations, count(t) AS times FROM c GROUP BY 1, 2""")
def slow_call_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = slow_calls.durations(slow_calls.calls(messages(spark, sf_dir)), 1000)
    return out.select("full_name", "part", F.concat(F.lit("["), F.array_join(F.col("ms").cast("array<string>"), ", "), F.lit("]")).alias("durations"), F.size("times").cast("long").alias("times"))


@query(CALLS + """, r AS (SELECT *, row_number() OVER (ORDER BY max_ms DESC, first_seq) AS k FROM s),
by_group AS (SELECT product_group, count(*) AS interfaces, max(max_ms) AS worst FROM s GROUP BY 1)
SELECT 'rank' AS section, CAST(k AS INTEGER) AS line_no, concat(k, '. ', short_name, ' ', printf('%.1f', max_ms / 1000.0), 's x', calls, ' ', product_group) AS line FROM r WHERE k <= 50
UNION ALL SELECT 'group', CAST(row_number() OVER (ORDER BY product_group) AS INTEGER), concat(product_group, ' ', interfaces, ' interfaces ', printf('%.1f', worst / 1000.0), 's') FROM by_group
UNION ALL SELECT 'severity', 1, concat('high=', count(*) FILTER (severity = 'high'), ' mid=', count(*) FILTER (severity = 'mid'), ' low=', count(*) FILTER (severity = 'low')) FROM s""")
def slow_call_text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.text_report(_stats(spark, sf_dir))


@query(CALLS + "SELECT product_group, full_name, CAST(row_number() OVER (PARTITION BY product_group ORDER BY max_ms DESC, first_seq) AS INTEGER) AS place FROM s")
def slow_calls_in_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = slow_calls.in_groups(_stats(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("product_group").orderBy(F.desc("max_ms"), "first_seq"))
    return ordered.select("product_group", "full_name", place.alias("place"))


@query(f"""
WITH m AS ({MESSAGES}),
g AS (SELECT event_type, count(*) AS total, count(*) FILTER (coalesce(TRY_CAST(regexp_extract(full_message, '耗时[：:]\\s*([0-9]+)', 1) AS BIGINT), 0) >= 15000) AS slow
      FROM m GROUP BY 1)
SELECT event_type, total, slow, slow * 100.0::DOUBLE / total AS ratio,
       CASE WHEN slow * 100.0::DOUBLE / total > 50 THEN 'critical' WHEN slow * 100.0::DOUBLE / total >= 10 THEN 'high'
            WHEN slow * 100.0::DOUBLE / total >= 1 THEN 'medium' ELSE 'low' END AS band FROM g""")
def slow_call_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.slow_ratio(messages(spark, sf_dir), ["event_type"])


@query(CALLS + """, r AS (SELECT *, row_number() OVER (ORDER BY max_ms DESC, first_seq) AS k FROM s)
SELECT 0 AS line_no, '| # | interface | group | calls | max s | severity |' AS line UNION ALL SELECT 1, '| --- | --- | --- | --- | --- | --- |'
UNION ALL SELECT CAST(k + 1 AS INTEGER), concat('| ', k, ' | ', short_name, ' | ', product_group, ' | ', calls, ' | ', printf('%.1f', max_ms / 1000.0), ' | ', severity, ' |')
FROM r WHERE k <= 20""")
def slow_call_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slow_calls.report(_stats(spark, sf_dir))


@query("SELECT user_id AS trace_id, count(*) AS rows, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS seconds FROM events GROUP BY 1")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.summary(table(spark, sf_dir, "events").withColumnRenamed("user_id", "trace_id"))


OPS = [("db", "^(view|click)"), ("remote", "^purchase")]


def _ops(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id", traces.classify(F.col("event_type"), OPS).alias("op"), (F.col("event_id") * 7919 % 90000).alias("ms"), "ts", "event_id")


_OPS_SQL = """WITH o AS (SELECT user_id, ts, event_id, CASE WHEN regexp_matches(event_type, '^(view|click)') THEN 'db' WHEN regexp_matches(event_type, '^purchase') THEN 'remote' ELSE 'other' END AS op,
  event_id * 7919 % 90000 AS ms FROM events)"""


@query(_OPS_SQL + """, g AS (SELECT user_id, op, count(*) AS calls, CAST(sum(ms) AS BIGINT) AS cost_ms FROM o GROUP BY 1, 2)
SELECT *, cost_ms / calls AS mean_ms, cost_ms / sum(cost_ms) OVER (PARTITION BY user_id) AS share FROM g""")
def operation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.costs(_ops(spark, sf_dir), ["user_id"], "op", "ms")


@query("SELECT user_id, event_type, count(*) AS rows, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM events GROUP BY 1, 2")
def trace_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.distribution(table(spark, sf_dir, "events"), "user_id", "event_type")


@query(_OPS_SQL + """, g AS (SELECT user_id, op, count(*) AS calls, count(*) / sum(count(*)) OVER (PARTITION BY user_id) AS share FROM o GROUP BY 1, 2)
SELECT *, share > 0.3 AS dominant FROM g WHERE calls >= 3""")
def operation_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.repeats(_ops(spark, sf_dir), "user_id", "op")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3")
def field_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.terms(table(spark, sf_dir, "events"), "event_type", 3)


@query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND contains(props, '\"k\": 1') AND NOT coalesce(user_id = 7, false) AND value IS NOT NULL")
def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = traces.search(table(spark, sf_dir, "events"), {"event_type": "click"}, ("props", '"k": 1'), {"user_id": 7}, ["value"])
    return found.select("event_id", "user_id")


@query("SELECT event_id FROM events ORDER BY ts, event_id LIMIT 500 OFFSET 1000")
def log_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.page(table(spark, sf_dir, "events"), ["ts", "event_id"], 1000, 500).select("event_id")


@query("""SELECT * FROM (SELECT user_id, lag(ts) OVER w AS gap_start, ts AS gap_end, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6::DOUBLE AS gap_s
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE gap_s >= 3600""")
def log_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", 3600)


@query("""SELECT event_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6::DOUBLE AS next_s FROM events""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.stage_times(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("event_id", "next_s")


@query("""SELECT p.event_id AS point, e.event_id FROM events p JOIN events e ON p.user_id = e.user_id AND p.event_type = 'purchase'
  AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 600 * 1000000""")
def logs_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    points = e.where("event_type = 'purchase'").select(F.col("event_id").alias("point"), "user_id", F.col("ts").alias("at"))
    return traces.around(points, e, "user_id", 600).select("point", "event_id")


_SPANS = """SELECT o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 2592000) AS held_from,
  TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey * 7919 % 2592000 + CASE WHEN o_orderkey % 1000 = 7 THEN 86400 ELSE o_custkey % 900 END) AS held_to FROM {o}"""


@query("""WITH o AS (SELECT o_orderkey, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000) AS held_from,
  TIMESTAMP '2024-01-01 00:00:00' + to_seconds(o_orderkey * 7919 % 2592000 + CASE WHEN o_orderkey % 1000 = 7 THEN 86400 ELSE o_custkey % 900 END) AS held_to FROM orders),
e AS (SELECT event_id, ts, make_timestamp(epoch_us(ts) + CAST(floor(value) AS BIGINT) * 1000000) AS done FROM events)
SELECT event_id, o_orderkey FROM e JOIN o ON ts < held_to AND held_from < done""")
def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", "ts", "timestamp_micros(unix_micros(CAST(ts AS TIMESTAMP)) + CAST(floor(value) AS BIGINT) * 1000000) AS done")
    o = spark.sql(_SPANS, o=table(spark, sf_dir, "orders"))
    return intervals.overlap_join(e, o, ("ts", "done"), ("held_from", "held_to"), width=600).select("event_id", "o_orderkey")


@query("""WITH g AS (SELECT lag(ts) OVER (ORDER BY ts) AS gap_start, ts AS gap_end FROM events WHERE ts IS NOT NULL)
SELECT CAST(epoch_us(gap_start) AS BIGINT) AS start_us, CAST(epoch_us(gap_end) AS BIGINT) AS end_us FROM g WHERE epoch_us(gap_end) - epoch_us(gap_start) >= 120 * 1000000""")
def quiet_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = intervals.quiet_spans(table(spark, sf_dir, "events"), "ts", 120)
    return out.select(F.unix_micros("gap_start").alias("start_us"), F.unix_micros("gap_end").alias("end_us"))


@query("""WITH n AS (SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS n FROM events), p AS (SELECT event_id, n // 500 AS page, n % 500 AS place FROM n)
SELECT event_id, page, place, count(*) OVER (PARTITION BY page) < 500 AS short FROM p""")
def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.pages(table(spark, sf_dir, "events").select("event_id", "value"), ["value", "event_id"]).select("event_id", "page", "place", "short")
