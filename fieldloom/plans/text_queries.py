"""Text, encoding and text-source operators over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import encodings, intervals, keyed, nested
from fieldloom.plans.registry import query
from fieldloom.shared import table
from fieldloom.sources import markup, texts


@query("SELECT doc_id, CASE WHEN octet_length(encode(text)) = length(text) THEN 'ascii' ELSE 'utf8' END AS encoding, CASE WHEN octet_length(encode(text)) = length(text) THEN 'warning' ELSE 'ok' END AS verdict FROM documents")
def encoding_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return encodings.detect(d).select("doc_id", "encoding", encodings.verdict(F.col("encoding"), "utf8").alias("verdict"))


@query("""WITH f AS (SELECT source AS root, doc_id AS path, CASE WHEN octet_length(encode(text)) = length(text) THEN 0 ELSE 1 END AS other FROM documents),
s AS (SELECT *, sum(other) OVER (PARTITION BY root ORDER BY path ROWS UNBOUNDED PRECEDING) AS seen FROM f)
SELECT root, count(*) AS files, CASE WHEN sum(other) > 0 THEN 'utf8' ELSE 'insufficient' END AS verdict FROM s WHERE seen <= 20 GROUP BY root""")
def encoding_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("root"), F.col("doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return encodings.root_verdict(encodings.detect(d).drop("content"))


@query(r"""SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS hash FROM documents""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(r"""WITH c AS (SELECT doc_id, unnest(list_filter([
  CASE WHEN regexp_matches(text, '(^|[^0-9])(?:[0-9]{1,3}\.){3}[0-9]{1,3}([^0-9]|$)') THEN 'IPv4 address' END,
  CASE WHEN regexp_matches(text, '(?i)\b(?:https?|sftp)://') THEN 'network URL' END,
  CASE WHEN regexp_matches(text, '(?i)\b[A-Z]:\\') THEN 'Windows absolute path' END,
  CASE WHEN regexp_matches(text, '(?i)(?:^|[\s"''`])/(?:opt|var|home|usr|srv)/') THEN 'server absolute path' END,
  CASE WHEN regexp_matches(text, '(?im)\b(?:password|passwd|token|secret|account|username|namespace|remotePath)\b\s*[:=]\s*["'']?[^"''\s,}]+') THEN 'secret or connection assignment' END,
  CASE WHEN regexp_matches(text, '(?m)[A-Za-z0-9+/]{256,}={0,2}') THEN 'long Base64 payload' END,
  CASE WHEN regexp_matches(text, '(?i)<\?xml\s') THEN 'complete XML payload' END], lambda x: x IS NOT NULL)) AS class FROM documents)
SELECT * FROM c""")
def redaction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.redaction_classes(F.col("text"))).alias("class"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9一-鿿._-]+', '-', 'g'), '-+', '-', 'g'), '^[-._]+|[-._]+$', '', 'g') AS slug,
  regexp_replace(lower(url), '[^a-z0-9_一-鿿]+', '', 'g') AS key, CASE WHEN starts_with(url, 'https://') THEN url ELSE 'https://' || url END AS prefixed,
  CASE WHEN regexp_matches(html, '(?i)^\\s*<\\?xml[^>]*encoding') THEN 'declared' ELSE 'utf-8' END AS encoding FROM pages""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", T.slug(u).alias("slug"), T.match_key(u).alias("key"), T.with_prefix(u, "https://").alias("prefixed"),
                                                T.declared_encoding(F.col("html")).alias("encoding"))


_FILES = """concat('./', replace(regexp_extract(url, '://([^?#]*)', 1), '/', '{0}'), CASE page_id % 5 WHEN 0 THEN '.cls' WHEN 1 THEN '.CSP' WHEN 2 THEN '.js' WHEN 3 THEN '.png' ELSE '.none' END)"""


@query(f"""WITH p AS (SELECT page_id, regexp_replace(replace({_FILES.format(chr(92))}, '{chr(92)}', '/'), '/+', '/', 'g') AS path FROM pages)
SELECT page_id, substr(path, 3) AS path, CASE page_id % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'page' WHEN 2 THEN 'web-asset' WHEN 3 THEN 'web-asset' ELSE 'other' END AS kind FROM p""")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_FILES.format(chr(92) * 2))
    return table(spark, sf_dir, "pages").select("page_id", T.normal_path(path).alias("path"), T.file_kind(path).alias("kind"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, 'json' AS shape FROM events""")
def relaxed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.relaxed_map(F.col("props"))["k"].alias("k"), T.data_shape(F.col("props")).alias("shape"))


@query("""WITH c AS (SELECT doc_id, length(coalesce(text, '')) AS n, CAST(greatest(ceil(length(coalesce(text, '')) / 600.0), 1) AS INTEGER) AS k FROM documents)
SELECT doc_id, k AS chunks, CAST(n - (k - 1) * 600 AS INTEGER) AS last, true AS whole FROM c""")
def payload_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("c", T.chunks(F.col("text"), 600))
    staged = F.reverse(F.transform("c", lambda x, i: F.struct(i.alias("place"), x.alias("piece"))))
    return d.select("doc_id", F.size("c").alias("chunks"), F.length(F.element_at("c", -1)).alias("last"), (T.reassembled(staged, F.size("c")) == F.coalesce("text", F.lit(""))).alias("whole"))


@query("""WITH r AS (SELECT n_nationkey, [n_name, r_name || '|x'] || CASE WHEN n_nationkey % 2 = 0 THEN ['even'] ELSE [] END AS c FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, '| ' || array_to_string([replace(x, '|', '\\|') for x in c], ' | ') || CASE WHEN len(c) = 2 THEN ' | ' ELSE '' END || ' |' AS line FROM r""")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cells = F.concat(F.array("n_name", F.concat("r_name", F.lit("|x"))), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("even"))).otherwise(F.array().cast("array<string>")))
    return n.select("n_nationkey", T.markdown_row(cells, 3).alias("line"))


@query("""SELECT d.doc_id, count(l) AS lines, count(*) FILTER (length(l) > 200) AS long_lines
FROM documents d LEFT JOIN (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) s ON s.doc_id = d.doc_id GROUP BY d.doc_id""")
def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ls = d.select("doc_id").join(texts.lines(d, "doc_id", "text"), "doc_id", "left")
    return ls.groupBy("doc_id").agg(F.count("line").alias("lines"), F.count_if(F.length("line") > 200).alias("long_lines"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, CASE WHEN length(line) < 60 THEN line END AS title FROM l)
SELECT doc_id, line_no, coalesce(
  last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),
  first_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) AS near_title,
  last_value(title IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM t""")
def nearest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = texts.lines(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("title", F.when(F.length("line") < 60, F.col("line")))
    out = intervals.carried(intervals.nearest_title(ls, "title", ["doc_id"], "line_no"), "title", ["doc_id"], "line_no", "section")
    return out.select("doc_id", "line_no", "near_title", "section")


@query("""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, i, line, unnest(string_split(line, '. ')) AS sentence, generate_subscripts(string_split(line, '. '), 1) - 1 AS j FROM l)
SELECT conv_id, turn, 'said.role' AS path, '' AS at, role AS value FROM conversations
UNION ALL SELECT conv_id, turn, 'said.lines[].size', CAST(i AS VARCHAR), CAST(length(line) AS VARCHAR) FROM l
UNION ALL SELECT conv_id, turn, 'said.lines[].sentences[]', i || ',' || j, sentence FROM w
UNION ALL SELECT conv_id, turn, 'said.lines[]', '', NULL FROM conversations WHERE text IS NULL""")
def nested_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.length(x).alias("size"), F.split(x, r"\. ", -1).alias("sentences")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct("role", lines.alias("lines")).alias("said"))
    return nested.flatten_paths(rows, ["conv_id", "turn"]).withColumn("at", F.array_join(F.col("at").cast("array<string>"), ","))


_PLACES = """SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS place FROM pages"""


@query(f"""WITH p AS ({_PLACES}), cut AS (SELECT page_id, string_split(place, '/') AS parts FROM p),
above AS (SELECT page_id, unnest(range(1, len(parts) + 1)) AS n, parts FROM cut),
a AS (SELECT DISTINCT page_id, array_to_string(parts[1:n], '/') AS root FROM above),
roots AS (SELECT root, min('m' || CAST(page_id % 5 AS VARCHAR)) AS mode FROM a WHERE page_id % 2 = 0 GROUP BY 1),
best AS (SELECT page_id, arg_max(root, length(root)) AS root, arg_max(mode, length(root)) AS mode FROM a JOIN roots USING (root) GROUP BY 1)
SELECT p.page_id, place, root, mode FROM p LEFT JOIN best USING (page_id)""")
def rooted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = spark.sql(_PLACES.replace("FROM pages", "FROM {p}"), p=table(spark, sf_dir, "pages"))
    parts = F.split("place", "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    roots = places.where("page_id % 2 = 0").select(F.explode(above).alias("root"), F.concat(F.lit("m"), (F.col("page_id") % 5).cast("string")).alias("mode"))
    return keyed.longest_root(places, "place", roots, ["page_id"])


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf8' END WHEN 1 THEN 'unknown' WHEN 2 THEN 'gb2312' ELSE 'unknown' END AS encoding FROM documents""")
def byte_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    ascii_ = F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", ""), "US-ASCII")
    at = F.col("doc_id") % 4
    # UTF-16 with its mark; a character that only the wider GB code page has; a byte that begins nothing
    content = F.when(at == 0, F.encode("text", "UTF-8")).when(at == 1, F.encode("text", "UTF-16")).when(at == 2, F.concat(ascii_, F.unhex(F.lit("E946")))).otherwise(F.concat(F.unhex(F.lit("FF")), ascii_))
    return encodings.detect(d.select("doc_id", F.lit("p").alias("path"), content.alias("content"))).select("doc_id", "encoding")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
m AS (SELECT *, CASE WHEN contains(line, 'oi') THEN 'end' WHEN contains(line, 'the') THEN 'begin' END AS mark FROM l),
s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM m),
c AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(line, '[A-Z][a-z]+'))) AS BIGINT) AS capitals, CAST(sum(len(regexp_extract_all(line, '[0-9]+'))) AS BIGINT) AS numbers,
  CAST(sum(len(regexp_extract_all(line, '[.,;]'))) AS BIGINT) AS stops FROM s WHERE mark IS NULL AND held = 'begin' GROUP BY 1)
SELECT doc_id, coalesce(capitals, 0) AS capitals, coalesce(numbers, 0) AS numbers, coalesce(stops, 0) AS stops FROM documents LEFT JOIN c USING (doc_id) WHERE text IS NOT NULL""")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = T.region_counts(F.col("text"), {"capitals": "[A-Z][a-z]+", "numbers": "[0-9]+", "stops": "[.,;]"}, "the", "oi")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", counts.alias("c")).select("doc_id", "c.*")


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN false WHEN user_id % 3 = 0 THEN false WHEN user_id % 3 = 1 AND event_type = 'click' THEN false ELSE true END AS writes,
  event_id % 2 + 1 AS changed, CASE WHEN user_id % 2 = 0 THEN '%' || user_id || ',{' || event_id % 10 || '}' ELSE '' END AS holes, CASE WHEN event_id % 4 = 3 THEN '' ELSE event_type END AS second,
  CASE event_type WHEN 'click' THEN 'enabled' WHEN 'view' THEN 'disabled' ELSE 'available' END AS state, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS value, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS cjk FROM events""")
def call_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tool calls, diffs, delimited records and settings made of events' values say."""
    e = table(spark, sf_dir, "events")
    id_, kind, user = F.col("event_id"), F.col("event_type"), F.col("user_id")
    tool = F.when(kind == "view", "list").otherwise("query")
    args = F.create_map(F.lit("mode"), F.when(user % 3 == 0, "count").otherwise("run"), F.lit("sql"), F.when((user % 3 == 1) & (kind == "click"), "  SELECT 1").otherwise("update t"))
    diff = F.concat(F.lit("--- a\n+++ b\n context\n-"), kind, F.when(id_ % 2 == 1, "\n+new").otherwise(""))
    holes = F.when(user % 2 == 0, F.concat(F.lit("a {"), (id_ % 10).cast("string"), F.lit("} %"), user.cast("string"))).otherwise("a {x}")
    record = F.concat(F.lit("first"), F.when(id_ % 4 != 3, F.concat(F.lit("^"), kind)).otherwise(""))
    state = F.when(kind == "click", " Initialized").when(kind == "view", "DISABLED").otherwise(kind)
    xml = F.concat(F.lit("<a x=\"中\" y = \"plain\" z=\""), F.when(id_ % 2 == 0, kind).otherwise("文"), F.lit("\"/>"))
    return e.select("event_id", T.writes(tool, args, ("list",)).alias("writes"), T.changed_lines(diff).cast("long").alias("changed"), F.array_join(T.placeholders(holes), ",").alias("holes"),
                    T.piece(record, 2).alias("second"), T.status(state).alias("state"), T.configured(F.when(id_ % 5 == 0, F.concat(F.lit("TODO "), kind)).otherwise(kind)).alias("value"), T.cjk_attributes(xml).alias("cjk"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (3, 4) THEN 'review' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 = 2 THEN 'planned' ELSE 'applied' END
  WHEN CASE doc_id % 3 WHEN 1 THEN 'utf8' ELSE 'gb2312' END = CASE doc_id % 5 WHEN 0 THEN 'utf8' WHEN 1 THEN 'gb2312' ELSE 'mixed' END THEN 'unchanged' ELSE 'conflict' END AS state FROM documents""")
def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    verdict = F.element_at(F.array(*map(F.lit, ("utf8", "gb2312", "mixed", "unknown", "insufficient"))), (d % 5 + 1).cast("int"))
    roots = table(spark, sf_dir, "documents").select("doc_id", verdict.alias("verdict"), F.when(d % 3 == 1, "utf8").when(d % 3 == 2, "gb2312").alias("declared"))
    return encodings.profile_state(roots).select("doc_id", "state")


@query("""SELECT c_custkey, c_name AS code, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment ELSE c_mktsegment || ',' || c_nationkey END AS tags, CAST(c_nationkey AS VARCHAR) AS place,
  '<Request><code>' || c_name || '</code><item kind="' || c_nationkey || '">x</item>' || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '<tag>' || c_mktsegment || '</tag>' ELSE '<tag>' || c_mktsegment || '</tag><tag>' || c_nationkey || '</tag>' END
  || '</Request>' AS again FROM customer""")
def xml_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML made of customers, with none, one or two tags, read as objects by the schema of all, and written again."""
    tag = lambda c: F.concat(F.lit("<tag>"), F.col(c).cast("string"), F.lit("</tag>"))
    tags = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, tag("c_mktsegment")).otherwise(F.concat(tag("c_mktsegment"), tag("c_nationkey")))
    xml = F.concat(F.lit("<Request>"), tags, F.lit("<code>"), F.col("c_name"), F.lit('</code><item kind="'), F.col("c_nationkey").cast("string"), F.lit('">x</item></Request>'))
    out = markup.xml_objects(table(spark, sf_dir, "customer").select("c_custkey", xml.alias("xml")), "xml")
    return out.select("c_custkey", "object.code", F.array_join("object.tag", ",").alias("tags"), F.col("object.item._kind").alias("place"), markup.objects_xml(F.col("object"), "Request").alias("again"))
