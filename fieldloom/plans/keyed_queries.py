"""Keyed comparison, mapping and lookups over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import keyed, updates
from fieldloom.plans.registry import query
from fieldloom.shared import table

#: Two sides of a keyed text, in words that Spark and DuckDB share.
SERVER = """SELECT c_nationkey AS lang, c_custkey AS item, CASE WHEN c_custkey % 11 = 0 THEN '' WHEN c_custkey % 13 = 0 THEN concat(c_name, '!') ELSE c_name END AS text
FROM customer WHERE c_custkey % 5 <> 0"""
LOCAL = "SELECT c_nationkey AS lang, c_custkey AS item, c_name AS text FROM customer WHERE c_custkey % 7 <> 0"


def _sides(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return [spark.sql(q.replace("FROM customer", "FROM {c}"), c=c) for q in (SERVER, LOCAL)]


DIFF = f"""WITH s AS ({SERVER}), l AS ({LOCAL}), d AS (
SELECT coalesce(s.lang, l.lang) AS lang, coalesce(s.item, l.item) AS item, s.text AS server_text, l.text AS local_text,
  CASE WHEN l.item IS NULL THEN 'Server-Only' WHEN s.item IS NULL THEN 'Local-Only' WHEN s.text = l.text THEN 'Match' WHEN s.text = '' THEN 'Server-Empty' ELSE 'Conflict' END AS diff
FROM s FULL JOIN l ON s.lang = l.lang AND s.item = l.item)"""


@query(DIFF + "SELECT * FROM d")
def keyed_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.diff(*_sides(spark, sf_dir), ["lang", "item"])


@query(DIFF + """SELECT lang, item, CASE WHEN diff IN ('Server-Only', 'Conflict') THEN server_text ELSE local_text END AS result,
  CASE diff WHEN 'Server-Only' THEN 'add' WHEN 'Conflict' THEN 'overwrite' ELSE 'keep' END AS action FROM d""")
def diff_server_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.resolve(keyed.diff(*_sides(spark, sf_dir), ["lang", "item"]), "server-wins").select("lang", "item", "result", "action")


@query(DIFF + """SELECT lang, item, coalesce(local_text, server_text) AS result,
  CASE WHEN diff IN ('Local-Only', 'Conflict', 'Server-Empty') THEN 'write-server' ELSE 'keep' END AS action FROM d""")
def diff_local_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.resolve(keyed.diff(*_sides(spark, sf_dir), ["lang", "item"]), "local-wins").select("lang", "item", "result", "action")


@query(f"""WITH s AS ({SERVER}), l AS ({LOCAL})
SELECT s.*, CASE WHEN l.item IS NULL THEN 'insert' WHEN l.text IS NOT DISTINCT FROM s.text THEN 'skip' ELSE 'conflict' END AS action FROM s LEFT JOIN l USING (lang, item)""")
def seed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.seed(*_sides(spark, sf_dir), ["lang", "item"], "text")


@query("""WITH t AS (SELECT p_partkey AS key, p_name AS value FROM part WHERE p_partkey % 3 <> 0), h AS (SELECT p_partkey AS key, p_brand AS value FROM part WHERE p_partkey % 4 <> 0)
SELECT key, value, 'added' AS state FROM t ANTI JOIN h USING (key) UNION ALL SELECT key, value, 'kept' FROM h SEMI JOIN t USING (key)
UNION ALL SELECT key, value, 'deprecated' FROM h ANTI JOIN t USING (key)""")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return keyed.config_merge(p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("value")),
                              p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("value")))


@query("""WITH s AS (SELECT concat('N', s_nationkey % 30) AS name FROM supplier), t AS (SELECT concat('n', n_nationkey, '-en') AS name FROM nation WHERE n_nationkey % 2 = 0)
SELECT name, count(*) AS records, (SELECT min(t.name) FROM t WHERE upper(t.name) = upper(s.name || '-EN')) AS target_name,
  (SELECT min(t.name) FROM t WHERE upper(t.name) = upper(s.name || '-EN')) IS NOT NULL AS verified FROM s GROUP BY name""")
def verify_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("N"), (F.col("s_nationkey") % 30).cast("string")).alias("name"))
    t = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("-en")).alias("name"))
    return keyed.verify_targets(s, t, "name", "EN")


@query("""SELECT c_custkey, CASE WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'missing-source'
  WHEN c_custkey IN (SELECT s_suppkey FROM supplier) THEN 'exists' ELSE 'save' END AS outcome FROM customer""")
def upsert_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("c_custkey"))
    return keyed.upsert_plan(key("customer", "c_custkey"), key("orders", "o_custkey"), key("supplier", "s_suppkey"), "c_custkey")


@query("""SELECT coalesce(w.path, h.path) AS path, CASE WHEN h.content IS NULL THEN 'missing' WHEN w.content IS NULL THEN CASE WHEN generated THEN 'removed' ELSE 'foreign' END
  WHEN NOT generated THEN 'conflict' WHEN w.content = h.content THEN 'unchanged' ELSE 'stale' END AS state
FROM (SELECT p_partkey AS path, p_type AS content FROM part WHERE p_partkey % 3 <> 0) w
FULL JOIN (SELECT p_partkey AS path, CASE WHEN p_size > 25 THEN p_type ELSE p_name END AS content, p_size % 2 = 0 AS generated FROM part WHERE p_partkey % 5 <> 0) h ON w.path = h.path""")
def index_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    want = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("content"))
    have = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("path"), F.expr("CASE WHEN p_size > 25 THEN p_type ELSE p_name END").alias("content"), F.expr("p_size % 2 = 0").alias("generated"))
    return keyed.index_states(want, have)


@query("""WITH p AS (SELECT n_nationkey % 5 AS dict_id, CAST(n_nationkey AS VARCHAR) AS hiscode, CAST(n_nationkey + 100 AS VARCHAR) AS extcode, n_name AS extname FROM nation WHERE n_nationkey % 6 <> 0)
SELECT c_custkey, 'sys' || r_regionkey % 2 AS system, r_name AS dict, CAST(c_nationkey AS VARCHAR) AS code, extcode AS mapped, extname AS mapped_name
FROM customer JOIN region ON r_regionkey = c_nationkey % 5 LEFT JOIN p ON p.dict_id = r_regionkey AND p.hiscode = CAST(c_nationkey AS VARCHAR)""")
def code_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    system = F.concat(F.lit("sys"), (F.col("r_regionkey") % 2).cast("string"))
    systems = region.select((F.col("r_regionkey") % 2).alias("system_id"), system.alias("system")).distinct()
    dictionaries = region.select(F.col("r_regionkey").alias("dict_id"), (F.col("r_regionkey") % 2).alias("system_id"), F.col("r_name").alias("dict"))
    pairs = nation.select((F.col("n_nationkey") % 5).alias("dict_id"), F.col("n_nationkey").cast("string").alias("hiscode"), F.col("n_name").alias("hisname"),
                          (F.col("n_nationkey") + 100).cast("string").alias("extcode"), F.col("n_name").alias("extname"), F.lit("Y").alias("his_flag"),
                          F.when(F.col("n_nationkey") % 6 == 0, "Y").otherwise("N").alias("is_deleted"))
    codes = table(spark, sf_dir, "customer").join(region, F.col("r_regionkey") == F.col("c_nationkey") % 5).select(
        "c_custkey", system.alias("system"), F.col("r_name").alias("dict"), F.col("c_nationkey").cast("string").alias("code"))
    return keyed.map_codes(codes, systems, dictionaries, pairs)


@query("""SELECT l_orderkey, l_linenumber, o_custkey, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def lookup_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey"))
    out = keyed.chain(l, [(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey"), (c, "o_custkey"),
                          (table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")])
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_name", "n_name")


@query("""SELECT o_orderkey, c_name, n_name, s_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0
LEFT JOIN supplier ON s_suppkey = o_custkey""")
def merge_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name", F.col("c_nationkey").alias("nation"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("nation"), "n_name")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), "s_name")
    return keyed.merged(c, o, [n, s], "key").select("o_orderkey", "c_name", "n_name", "s_name")


BANDS = [(-199, -100, "parameter"), (-299, -200, "patient"), (-399, -300, "quota"), (-9999, -1000, "business")]


@query("SELECT l_orderkey, l_linenumber, -CAST(l_partkey AS BIGINT) AS code, CASE WHEN l_partkey BETWEEN 100 AND 199 THEN 'parameter' WHEN l_partkey BETWEEN 200 AND 299 THEN 'patient' "
       "WHEN l_partkey BETWEEN 300 AND 399 THEN 'quota' WHEN l_partkey BETWEEN 1000 AND 9999 THEN 'business' END AS band FROM lineitem")
def code_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame(BANDS, "lo int, hi int, band string")
    return keyed.ranges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (-F.col("l_partkey")).alias("code")), "code", bands)


ROOTS = [("en", "utf8"), ("en/1", "gb2312"), ("fr", "gb2312")]


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, CASE WHEN path = 'en/1' OR starts_with(path, 'en/1/') THEN 'gb2312' WHEN path = 'en' OR starts_with(path, 'en/') THEN 'utf8' WHEN path = 'fr' OR starts_with(path, 'fr/') THEN 'gb2312' ELSE 'default' END AS mode FROM p""")
def longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return p.select("page_id", keyed.longest_prefix(p, "path", ROOTS, "default").alias("mode"))


@query("""SELECT p_type AS capability, p_partkey AS plugin FROM (
  SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END, p_partkey) AS n FROM part) WHERE n = 1""")
def first_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "part").select(F.col("p_type").alias("capability"), F.col("p_partkey").alias("plugin"), F.col("p_partkey").alias("visit"),
                                                 F.expr("CASE WHEN p_size % 7 = 0 THEN 'required' ELSE 'optional' END").alias("kind"))
    return keyed.first_capability(offers).select("capability", "plugin")


@query("""SELECT c_name AS name, coalesce('a/' || s_suppkey, 'b/' || n_nationkey, 'nested/' || c_name) AS path
FROM customer LEFT JOIN supplier ON replace(s_name, 'Supplier', 'Customer') = c_name LEFT JOIN nation ON n_nationkey = c_custkey""")
def path_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    nested = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"), F.concat(F.lit("a/"), F.col("s_suppkey").cast("string")).alias("path"))
    root = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_custkey")).select(F.col("c_name").alias("name"), F.concat(F.lit("b/"), F.col("n_nationkey").cast("string")).alias("path"))
    return keyed.path_fallback(c.select(F.col("c_name").alias("name")), nested, root, "name")


@query("""WITH l AS (SELECT o_orderkey AS seq, concat(o_orderstatus, ' , ', o_orderpriority, ',,', lower(o_orderpriority)) AS names FROM orders),
u AS (SELECT seq, unnest(string_split(names, ',')) AS n, generate_subscripts(string_split(names, ','), 1) AS i FROM l),
t AS (SELECT seq, i, trim(n) AS n FROM u WHERE trim(n) <> '')
SELECT first(n ORDER BY seq, i) AS name, min(seq) AS first_seq FROM t GROUP BY lower(n)""")
def distinct_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat("o_orderstatus", F.lit(" , "), "o_orderpriority", F.lit(",,"), F.lower("o_orderpriority")).alias("names"))
    return keyed.distinct_names(l, "names", "seq")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE trim(o_orderstatus) <> '' GROUP BY 1 ORDER BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS "F", count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1""")
def schedule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.pivot_counts(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def schedule_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.where_given(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT", "o_custkey": None}).select("o_orderkey")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 3 AS BIGINT) AS normal, CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity * l_tax * 10 END AS BIGINT) AS ignoring FROM
  (SELECT l_orderkey, l_linenumber, l_quantity, floor(l_tax * 100) / 100 AS l_tax FROM lineitem)),
e AS (SELECT *, CASE WHEN normal > 0 THEN (normal - ignoring) / normal ELSE 0 END AS ratio FROM d)
SELECT *, CASE WHEN normal > 0 AND ignoring = 0 THEN 'whitespace-only' WHEN normal >= 80 AND ratio >= 0.7 THEN 'formatting-heavy' ELSE 'ok' END AS verdict FROM e""")
def whitespace_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 3).cast("long").alias("normal"),
        F.when(F.col("l_linenumber") == 2, 0.0).otherwise(F.rint(F.col("l_quantity") * (F.floor(F.col("l_tax") * 100) / 100) * 10)).cast("long").alias("ignoring"))
    return keyed.whitespace_shares(d)


@query("""SELECT c.c_custkey, n_name, o_orderkey FROM region r JOIN nation n ON n_regionkey = r_regionkey JOIN customer c ON c_nationkey = n_nationkey JOIN orders o ON o_custkey = c.c_custkey
WHERE (o_orderkey + c_nationkey) % 5 = r_regionkey""")
def tenant_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step names the tenant (a region) itself; a row of another tenant is never reached, whatever its keys."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("tenant"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")).join(n.select("n_nationkey", "tenant"), "n_nationkey")
    o = (table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
         .select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", ((F.col("o_orderkey") + F.col("c_nationkey")) % 5).cast("int").alias("tenant")))
    start = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("tenant"))
    return keyed.chain(start, [(n, "tenant"), (c, "n_nationkey"), (o, "c_custkey")], tenant="tenant").select("c_custkey", "n_name", "o_orderkey")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1999-06-30' AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def status_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.period_report(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus", ["F", "O", "P"], "o_orderdate", "1996-01-01", "1999-06-30", ("o_orderpriority", "1-URGENT"))


@query("""WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND CAST(o_orderdate AS DATE) >= DATE '1997-01-01')
SELECT 'row' AS kind, o_orderkey AS n FROM p UNION ALL SELECT 'count', count(*) FROM p""")
def schedule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rows = keyed.schedule_page(table(spark, sf_dir, "orders"), {"o_orderstatus": "O"}, {"o_custkey": None}, ("o_orderdate", "1997-01-01", None))
    return rows.select(F.lit("row").alias("kind"), F.col("o_orderkey").alias("n")).union(n.select(F.lit("count"), "n"))


@query("""WITH p AS (SELECT p_brand, p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS size FROM part)
SELECT p_brand, p_partkey, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY size NULLS LAST, p_partkey) AS place FROM p) WHERE place <= 5""")
def first_with_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("size"))
    return keyed.first_by(p, ["p_brand"], ["size", "p_partkey"], 5).select("p_brand", "p_partkey", "place")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_quantity < 5 OR l_suppkey = 3")
def any_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return keyed.any_of(l, [F.col("l_returnflag") == "R", F.col("l_quantity") < 5, F.col("l_suppkey") == 3]).select("l_orderkey", "l_linenumber")


@query("""SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'""")
def rollback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_returnflag") == "A", "insert").when(F.col("l_returnflag") == "R", "update").alias("action"))
    return updates.rollback_keys(done, ["l_orderkey", "l_partkey"])
