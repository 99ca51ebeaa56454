"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate; every document draws its copy count by inverting the
Poisson distribution at a uniform number hashed from the seed and the document, so the draw is
the same on any cluster and after any retry. Copies are exploded and shuffled globally by a
hashed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh, salted_join, table, unit_hash

#: Rates of at most so many sources are sent to every task; more are joined with salted keys.
BROADCAST_SOURCES = 10_000
#: The largest rate drawn at once; its distribution ends well inside MAX_COPIES terms. A larger
#: rate is split into equal parts, each with a draw of its own, that add up.
MAX_RATE = 32.0
MAX_COPIES = 128


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None,
          temperature: float = 0.5, total: int | None = None) -> DataFrame:
    """One row per source: ``source, n_docs, rate``.

    ``weights`` are target shares (any scale; sources not named get 0). Without them the target
    share is ``n_docs ** temperature``. ``total`` is the wanted number of rows (default: as many
    as there are). A null source counts as the source ''. Counts cover all documents; partial sums make a hot source cheap.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        raw = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        raw = F.coalesce(F.create_map(*pairs)[F.col("source")], F.lit(0.0)) if pairs else F.lit(0.0)
    # Integer weights add up exactly, in any order.
    sizes = sizes.withColumn("_w", F.round(raw * 1e6).cast("long"))
    sums = sizes.agg(F.sum("_w").alias("_sw"), F.sum("n_docs").alias("_sn"))
    want = F.lit(total).cast("double") if total is not None else F.col("_sn").cast("double")
    rate = want * F.col("_w").cast("double") / F.greatest(F.col("_sw"), F.lit(1)).cast("double") / F.col("n_docs").cast("double")
    # One row of sums: a broadcast of fixed size.
    return sizes.join(F.broadcast(sums)).select("source", "n_docs", rate.alias("rate"))


def _cdf(rate) -> "F.Column":
    """P(X <= k) for k = 0 .. MAX_COPIES - 1, by the recurrence p(k) = p(k-1) * rate / k."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc, k):
        p = acc["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COPIES - 1)), start, step, lambda acc: acc["all"])


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", weights: dict[str, float] | None = None,
        temperature: float = 0.5, total: int | None = None, seed: int = 7) -> DataFrame:
    """All columns of ``docs`` plus ``mix_rate double, mix_copies int, mix_copy int, mix_order string``.

    A document with count 0 is absent; one with count n appears n times (``mix_copy`` 1..n).
    Rows are dealt over partitions by ``mix_order`` and sorted by it inside each, which is a
    global shuffle. A row draws by its ``key`` and ``text`` (null marked apart), so rows without a key
    draw for themselves; only rows that repeat both draw alike. An empty table gives an empty result.
    Columns of ``docs`` named ``mix_rate``, ``mix_copies``, ``mix_copy`` or ``mix_order`` are replaced, others
    come back as they were.
    """
    docs = docs.drop("mix_rate", "mix_copies", "mix_copy", "mix_order")
    src, cdf, parts, rate, ident = fresh(docs, "source", "cdf", "parts", "mix_rate", "ident")
    n_parts = F.greatest(F.ceil(F.col("rate") / MAX_RATE), F.lit(1)).cast("int")
    r = rates(docs, source, weights, temperature, total).select(
        F.col("source").alias(src), F.col("rate").alias(rate), n_parts.alias(parts), _cdf(F.col("rate") / n_parts).alias(cdf))
    few = r.limit(BROADCAST_SOURCES + 1).collect()
    who = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit("|"), F.coalesce(F.md5(F.col(text)), F.lit("null")))
    keyed = docs.withColumn(src, F.coalesce(F.col(source), F.lit(""))).withColumn(ident, who)
    if len(few) <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(docs.sparkSession.createDataFrame(few, r.schema)), src, "left")
    else:
        joined = salted_join(keyed, r, src)

    def draw(u):
        return F.size(F.filter(cdf, lambda c: c <= u))

    # A sum of Poisson draws is a Poisson draw at the sum of the rates. The first part draws as an undivided rate does.
    draws = F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda part: unit_hash(F.lit(str(seed)), F.col(ident), part.cast("string")))
    first = F.transform(F.array(unit_hash(F.lit(str(seed)), F.col(ident))), draw)[0]
    copies = F.when(F.col(parts) > 1, first + F.aggregate(draws, F.lit(0), lambda n, u: n + draw(u))).otherwise(first)
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), F.col(ident), F.col("mix_copy").cast("string")))
    out = (joined.withColumn("mix_copies", copies).where("mix_copies > 0")
           .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).withColumn("mix_order", order)
           .select(*[F.col(c) for c in docs.columns], F.col(rate).alias("mix_rate"), "mix_copies", "mix_copy", "mix_order"))
    return out.repartition("mix_order").sortWithinPartitions("mix_order")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lang", "source", "n_chars", "mix_copies", "mix_copy", "mix_order")


OP9_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, CAST(round(pow(CAST(count(*) AS DOUBLE), 0.5) * 1e6) AS BIGINT) AS w
  FROM documents GROUP BY 1),
sums AS (SELECT sum(w) AS sw, sum(n) AS sn FROM sizes),
r AS (
  SELECT s, CAST(sn AS DOUBLE) * CAST(w AS DOUBLE) / CAST(sw AS DOUBLE) / CAST(n AS DOUBLE) AS rate FROM sizes, sums),
split AS (SELECT s, greatest(CAST(ceil(rate / {MAX_RATE}) AS INTEGER), 1) AS parts, rate / greatest(CAST(ceil(rate / {MAX_RATE}) AS INTEGER), 1) AS rate FROM r),
cdf AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM split
  UNION ALL
  SELECT s, rate, k + 1, p * rate / CAST(k + 1 AS DOUBLE), c + p * rate / CAST(k + 1 AS DOUBLE)
  FROM cdf WHERE k < {MAX_COPIES - 1}),
lists AS (SELECT s, list(c ORDER BY k) AS cs FROM cdf GROUP BY s),
named AS (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null') AS ident FROM documents),
drawn AS (
  SELECT d.*, cs, [CAST('0x' || substr(md5('7|' || ident || CASE WHEN p > 0 THEN '|' || p ELSE '' END), 1, 13) AS UBIGINT) / 4503599627370496.0::DOUBLE
                   FOR p IN range(parts)] AS us
  FROM named d JOIN split ON split.s = coalesce(source, '') JOIN lists ON lists.s = split.s),
counted AS (SELECT *, CAST(list_sum([len([x FOR x IN cs IF x <= u]) FOR u IN us]) AS INTEGER) AS mix_copies FROM drawn)
SELECT doc_id, text, lang, source, n_chars, mix_copies, CAST(mix_copy AS INTEGER) AS mix_copy, md5('7:order|' || ident || '|' || mix_copy) AS mix_order
FROM (SELECT *, unnest(generate_series(1, mix_copies)) AS mix_copy FROM counted WHERE mix_copies > 0)
"""
