"""Sequence and manifest checks over orders and their lines, read as runs and stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import graph, intervals, manifest
from fieldloom.plans.registry import query
from fieldloom.shared import placed_table, table


def _spans(spark, sf_dir):
    return spark.sql("SELECT o_custkey, o_orderdate AS a, o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 60 AS INT)) AS b FROM {o}", o=table(spark, sf_dir, "orders"))


@query("""
WITH s AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + to_days(CAST(o_orderkey % 60 AS INTEGER)) AS b FROM orders),
n AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM s),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isle FROM n),
u AS (SELECT o_custkey, isle, (epoch_us(max(b)) - epoch_us(min(a))) / 1e6::DOUBLE AS len FROM i GROUP BY 1, 2),
t AS (SELECT o_custkey, sum(len) AS union_s FROM u GROUP BY 1),
q AS (SELECT o_custkey, sum((epoch_us(b) - epoch_us(a)) / 1e6::DOUBLE) AS sum_s FROM s GROUP BY 1)
SELECT o_custkey, union_s, sum_s, CASE WHEN sum_s > 0 THEN union_s / sum_s END AS ratio, coalesce(CASE WHEN sum_s > 0 THEN union_s / sum_s END <= 0.75, true) AS passes
FROM t JOIN q USING (o_custkey)""")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.parallel_gate(_spans(spark, sf_dir), ["o_custkey"], "a", "b")


_STAGE = "CASE l_linenumber " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(manifest.STAGES, 1)) + " END"
#: Stages, in words that Spark and DuckDB share: a line of an order is a stage of a run.
STAGES = f"""
SELECT l_orderkey AS run_id, {_STAGE} AS name, CAST(l_suppkey % 4 AS VARCHAR(9)) AS actor,
       CASE WHEN l_returnflag = 'R' AND l_linenumber = 5 THEN 'not-applicable' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'running' END AS status,
       l_shipdate AS started, DAYS AS completed, l_linenumber AS attempt FROM lineitem"""
RUNS = """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 9 = 0 THEN '0.9' ELSE '1.2' END AS version, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS topic,
       CASE o_orderkey % 4 WHEN 0 THEN 'serial' WHEN 1 THEN 'multi-agent' WHEN 2 THEN 'retrospective' ELSE 'other' END AS mode,
       o_orderkey % 4 = 2 AND o_orderkey % 8 <> 2 AS retrospective, o_orderkey % 3 = 0 AS authorised,
       CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS started, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS completed, '' AS timing_reason FROM orders"""
_SPARK_DAYS = "l_shipdate + make_interval(0, 0, 0, CAST(l_quantity AS INT))"
_DUCK_DAYS = "l_shipdate + to_days(CAST(l_quantity AS INTEGER))"


def _stages(spark, sf_dir):
    return spark.sql(STAGES.replace("DAYS", _SPARK_DAYS).replace("FROM lineitem", "FROM {l}"), l=table(spark, sf_dir, "lineitem"))


def _placed_stages(spark, sf_dir):
    """Stages with their place in the table, which decides where an order by attempt and start leaves rows alike."""
    return spark.sql(STAGES.replace("DAYS", _SPARK_DAYS).replace("FROM lineitem", ", place FROM {l}"), l=placed_table(spark, sf_dir, "lineitem"))


def _runs(spark, sf_dir):
    return spark.sql(RUNS.replace("FROM orders", "FROM {o}"), o=table(spark, sf_dir, "orders"))


_WITH = f"WITH st AS ({STAGES.replace('DAYS', _DUCK_DAYS)}), ru AS ({RUNS})"
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in manifest.ORDER)


@query(_WITH + f""", pr(before, after) AS (VALUES {_PAIRS})
SELECT a.run_id, 'J8' AS rule, after AS subject, 'starts before ' || before || ' completes' AS message FROM pr JOIN st a ON a.name = before JOIN st b ON b.name = after AND b.run_id = a.run_id
JOIN ru ON ru.run_id = a.run_id AND NOT coalesce(retrospective, false)
WHERE a.status <> 'not-applicable' AND b.status <> 'not-applicable' AND b.started < a.completed""")
def manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.order_issues(_runs(spark, sf_dir), _stages(spark, sf_dir))


@query(_WITH + """
SELECT run_id, 'J1' AS rule, 'version' AS subject, 'unsupported version' AS message FROM ru WHERE version NOT IN ('1.0', '1.1', '1.2')
UNION ALL SELECT run_id, 'J1', 'topic', 'topic is empty' FROM ru WHERE trim(topic) = ''
UNION ALL SELECT run_id, 'J2', 'mode', 'unknown mode' FROM ru WHERE mode NOT IN ('serial', 'multi-agent', 'retrospective')
UNION ALL SELECT run_id, 'J2', 'mode', 'mode and retrospective flag differ' FROM ru WHERE (mode = 'retrospective') <> retrospective
UNION ALL SELECT run_id, 'J3', 'mode', 'not authorised' FROM ru WHERE mode = 'multi-agent' AND NOT authorised
UNION ALL SELECT run_id, 'J4', 'time', 'times are missing' FROM ru WHERE started IS NULL OR completed IS NULL
UNION ALL SELECT run_id, 'J4', 'time', 'ends before it starts' FROM ru WHERE completed < started""")
def manifest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.run_issues(_runs(spark, sf_dir))


@query(_WITH + f""", need AS (SELECT run_id, unnest({list(manifest.STAGES)}) AS name FROM ru)
SELECT run_id, 'J5' AS rule, name AS subject, 'required stage is missing' AS message FROM need ANTI JOIN st USING (run_id, name)
UNION ALL SELECT run_id, 'J5', name, 'stage is repeated' FROM st GROUP BY run_id, name HAVING count(*) > 1
UNION ALL SELECT run_id, 'J5', name, 'unknown status' FROM st WHERE status NOT IN {manifest.STATUSES}
UNION ALL SELECT run_id, 'J6', name, 'completed without times' FROM st WHERE status = 'completed' AND (started IS NULL OR completed IS NULL)
UNION ALL SELECT run_id, 'J6', name, 'ends before it starts' FROM st WHERE completed < started""")
def manifest_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.stage_issues(_runs(spark, sf_dir), _stages(spark, sf_dir))


@query(_WITH + f""", a AS (
  SELECT run_id, count(DISTINCT actor) AS actors, count(DISTINCT actor) FILTER (name IN {manifest.BUILDERS} AND status <> 'not-applicable') AS builders,
         list(actor) FILTER (name IN {manifest.BUILDERS} AND status <> 'not-applicable') AS b, max(actor) FILTER (name = 'verifier') AS v FROM st GROUP BY 1),
j AS (SELECT a.*, mode FROM a JOIN ru USING (run_id))
SELECT run_id, 'J9' AS rule, 'actors' AS subject, 'a serial run has one actor' AS message FROM j WHERE mode = 'serial' AND actors > 1
UNION ALL SELECT run_id, 'J9', 'builders', 'needs two builders' FROM j WHERE mode = 'multi-agent' AND builders < 2
UNION ALL SELECT run_id, 'J9', 'verifier', 'verifier is not independent' FROM j WHERE mode = 'multi-agent' AND v IS NOT NULL AND list_contains(b, v)""")
def manifest_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.actor_issues(_runs(spark, sf_dir), _stages(spark, sf_dir))


@query(f"""WITH st AS ({STAGES.replace('DAYS', _DUCK_DAYS)}), s AS (
  SELECT *, row_number() OVER w AS n, lag(completed) OVER w AS before FROM st WINDOW w AS (PARTITION BY run_id ORDER BY attempt, started))
SELECT run_id, attempt, CASE WHEN attempt <> n THEN 'attempt numbers are not 1..n' WHEN started < before THEN 'attempt overlaps the one before' ELSE 'attempt ends before it starts' END AS issue
FROM s WHERE attempt <> n OR started < before OR completed < started""")
def attempt_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.attempts(_placed_stages(spark, sf_dir), ["run_id"], "attempt", "started", "completed", ("place",))


@query("""SELECT l_partkey, l_suppkey % 10 AS path, count(DISTINCT l_returnflag) AS actors FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1""")
def ownership_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return intervals.ownership_conflicts(l.select("l_partkey", (F.col("l_suppkey") % 10).alias("path"), F.col("l_returnflag").alias("actor")), ["l_partkey"])


@query("""
WITH i AS (SELECT p_brand, p_name AS name, CAST(p_partkey % 97 AS DOUBLE) AS xcol, CAST(p_size AS DOUBLE) * 0.75 + p_partkey * 0.001 AS yrow, p_partkey FROM part),
j AS (SELECT *, CASE WHEN yrow - lag(yrow) OVER w > 0.5 THEN 1 ELSE 0 END AS jump FROM i WINDOW w AS (PARTITION BY p_brand ORDER BY yrow, xcol, p_partkey)),
k AS (SELECT *, CAST(sum(jump) OVER (PARTITION BY p_brand ORDER BY yrow, xcol, p_partkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line FROM j)
SELECT p_partkey, line, lead(xcol) OVER (PARTITION BY p_brand, line ORDER BY xcol, p_partkey) - xcol AS gap FROM k""")
def layout_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("name"), (F.col("p_partkey") % 97).cast("double").alias("xcol"),
                                                (F.col("p_size").cast("double") * 0.75 + F.col("p_partkey") * 0.001).alias("yrow"), "p_partkey")
    return intervals.layout_rows(items, ["p_brand"], "p_partkey", 0.5).select("p_partkey", "line", "gap")


@query("""
WITH i AS (SELECT p_brand, CAST(p_partkey % 97 AS DOUBLE) AS xcol, CAST(p_size AS DOUBLE) AS yrow, p_partkey, p_partkey % 3 <> 0 AS label, (p_partkey % 8) * 0.25::DOUBLE AS width FROM part),
j AS (SELECT *, CASE WHEN yrow - lag(yrow) OVER w > 0.5 THEN 1 ELSE 0 END AS jump FROM i WINDOW w AS (PARTITION BY p_brand ORDER BY yrow, xcol, p_partkey)),
k AS (SELECT *, sum(jump) OVER (PARTITION BY p_brand ORDER BY yrow, xcol, p_partkey ROWS UNBOUNDED PRECEDING) AS line FROM j),
s AS (SELECT p_partkey, label, lead(label) OVER w AS following, lead(xcol) OVER w - xcol - width AS free FROM k WINDOW w AS (PARTITION BY p_brand, line ORDER BY xcol, p_partkey)),
f AS (SELECT p_partkey, CASE WHEN label AND NOT following THEN free END AS space FROM s)
SELECT p_partkey, space, CASE WHEN space < 0 THEN 'overlap' WHEN space < 1.5 THEN 'tight' WHEN space > 2.5 THEN 'wide' WHEN space IS NOT NULL THEN 'ok' END AS fit FROM f""")
def label_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select("p_brand", (F.col("p_partkey") % 97).cast("double").alias("xcol"), F.col("p_size").cast("double").alias("yrow"), "p_partkey",
                                                (F.col("p_partkey") % 3 != 0).alias("label"), ((F.col("p_partkey") % 8) * F.lit(0.25)).alias("width"))
    return intervals.label_gaps(items, ["p_brand"], "p_partkey", "label", "width", 0.5).select("p_partkey", "space", "fit")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS name, p_partkey // 3 AS depends_on FROM part WHERE p_partkey // 3 > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey // 5 > 0),
r AS (SELECT p_partkey AS start, p_partkey AS name, 0 AS depth FROM part UNION SELECT start, depends_on, depth + 1 FROM r JOIN e USING (name))
SELECT start, name, min(depth) AS depth FROM r GROUP BY 1, 2""")
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    edges = _edges(p)
    return graph.closure(edges, p.select(F.col("p_partkey").alias("name")))


def _edges(p):
    return p.select(F.col("p_partkey").alias("name"), F.explode(F.array(F.floor(F.col("p_partkey") / 3), F.floor(F.col("p_partkey") / 5))).alias("depends_on")).where("depends_on > 0")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS name, p_partkey // 3 AS depends_on FROM part WHERE p_partkey // 3 > 0 UNION SELECT p_partkey, p_partkey // 5 FROM part WHERE p_partkey // 5 > 0),
names AS (SELECT name FROM e UNION SELECT depends_on FROM e),
l AS (SELECT name, 0 AS level FROM names WHERE name NOT IN (SELECT name FROM e) UNION SELECT e.name, level + 1 FROM l JOIN e ON e.depends_on = l.name)
SELECT name, max(level) AS level FROM l GROUP BY 1""")
def dependency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(_edges(table(spark, sf_dir, "part")))


_ATTEMPTS = """SELECT run_id, name AS stage, attempt, CASE WHEN status = 'running' THEN 'suspended' WHEN run_id % 11 = 0 THEN 'odd' ELSE status END AS status, started, completed,
  CASE WHEN run_id % 7 = 0 THEN NULL WHEN run_id % 5 = 0 THEN 1e9 ELSE 10.0 END AS active_seconds, CASE WHEN run_id % 13 = 0 THEN NULL ELSE '' END AS reason FROM st WHERE attempt < 7"""


@query(f"""WITH st AS ({STAGES.replace('DAYS', _DUCK_DAYS)}), r AS ({RUNS}), one AS (SELECT run_id FROM r WHERE version = '1.2'),
a AS (SELECT * FROM ({_ATTEMPTS}) WHERE run_id IN (FROM one)),
e AS (SELECT run_id, stage, coalesce(list_filter([
    CASE WHEN active_seconds IS NULL OR reason IS NULL THEN 'attempt is incomplete' END, CASE WHEN status NOT IN ('completed', 'blocked', 'suspended') THEN 'unknown attempt status' END,
    CASE WHEN completed < started THEN 'attempt times are invalid' END,
    CASE WHEN completed >= started AND (active_seconds IS NULL OR active_seconds > epoch_us(completed) / 1e6 - epoch_us(started) / 1e6) THEN 'active seconds are invalid' END], lambda x: x IS NOT NULL), []) AS said FROM a),
g AS (SELECT run_id, stage, arg_max(status, struct_pack(a := attempt, s := started)) AS last FROM a GROUP BY 1, 2),
p AS (SELECT st.run_id, name AS stage, list_filter([CASE WHEN status = 'not-applicable' AND g.run_id IS NOT NULL THEN 'a stage that doesn''t apply has attempts' END,
    CASE WHEN status <> 'not-applicable' AND g.run_id IS NULL THEN 'stage has no attempt' END, CASE WHEN last = 'suspended' THEN 'stage ends with a suspended attempt' END], lambda x: x IS NOT NULL) AS said
  FROM st LEFT JOIN g ON g.run_id = st.run_id AND g.stage = st.name WHERE st.run_id IN (FROM one))
SELECT run_id, stage AS subject, unnest(said) AS message FROM e UNION ALL SELECT run_id, stage, unnest(said) FROM p""")
def manifest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = _stages(spark, sf_dir)
    attempts = spark.sql(_ATTEMPTS.replace("FROM st", ", place FROM {st}"), st=_placed_stages(spark, sf_dir))
    return manifest.attempt_rules(_runs(spark, sf_dir), stages, attempts, ("place",)).select("run_id", "subject", "message")


def _installed(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("Part-"), key).alias("name"), F.concat(F.lit("F"), key).alias("folder"))


@query("""SELECT DISTINCT 'Part-' || p_partkey AS name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' AND l_quantity > 45""")
def enabled_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    profile = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") == 1, F.concat(F.lit("PART-"), key)).otherwise(F.concat(F.lit(" f"), key)).alias("key"),
                                                      F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "Enabled").otherwise("off").alias("state"))
    return graph.starts(_installed(spark, sf_dir), profile)


@query("""SELECT l_orderkey, l_linenumber, 'Part-' || p_partkey AS depends_on FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 3 <> 2""")
def installed_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, form = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 3
    called = F.when(form == 0, F.concat(F.lit("f"), key)).when(form == 1, F.concat(F.lit("PART-"), key, F.lit(" "))).otherwise(F.concat(F.lit("other-"), key))
    return graph.as_installed(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", called.alias("depends_on")), "depends_on", _installed(spark, sf_dir))
