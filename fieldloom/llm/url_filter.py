"""URL filters by empirical-Bayes host reputation, with DataFrame expressions only.

Labelled page outcomes (1 bad, 0 good) are counted per host, registered domain and suffix. Each
level's beta prior is centred on the posterior mean of the level above, with a strength found
by the method of moments, so a host with few pages borrows from its domain and a domain from
its suffix. A host is blocked when even the lower bound of its posterior bad rate is high.
Rules on (host, path) go before that: the longest that fits wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import fresh, materialize, salted_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered; others are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
#: Standard deviations between the posterior mean and its lower bound.
Z = 1.0
#: A host is blocked when the lower bound of its bad rate is at least this.
BAD_RATE = 0.10
#: Bounds of a prior's strength, in pages.
STRENGTH = (2.0, 1000.0)


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``: the host after the first ``://`` up to ``/ ? #`` or the end,
    A-Z lower-cased, and the path up to ``? #`` or the end; both empty for null and without ``://``."""
    rest, bare = fresh(df, "rest", "bare")
    at = F.instr(F.col(url), "://")
    after = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(F.lit(""))
    df = df.withColumn(rest, F.regexp_extract(after, r"(?s)^([^?#]*)", 1))
    df = df.withColumn(bare, F.substring_index(rest, "/", 1))
    return (df.withColumn("path", F.substr(F.col(rest), F.length(bare) + 1))
            .withColumn("host", F.translate(bare, UPPER, LOWER)).drop(rest, bare))


def domain_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host. ``suffixes``: those of several labels under which names are
    registered, as a public list has them; the longest that fits counts, else the last label."""
    suffix, domain = F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)
    for labels in sorted({s.count(".") + 1 for s in suffixes}):
        end = F.substring_index(host, ".", -labels)
        fits = end.isin(*[s for s in suffixes if s.count(".") + 1 == labels])
        suffix, domain = F.when(fits, end).otherwise(suffix), F.when(fits, F.substring_index(host, ".", -labels - 1)).otherwise(domain)
    return domain, suffix


def _strength(df: DataFrame, by: list[str]) -> DataFrame:
    """Prior strength of the groups' rates (columns ``n``, ``k``) within each ``by``.

    Moments of the rates give strength = p(1-p)/v - 1, where v is the variance between groups
    less what binomial sampling explains. Sums are of decimals, so any order gives the same.
    """
    sq = F.round(F.col("k").cast("double") * F.col("k") / F.col("n"), 9).cast("decimal(28,9)")
    a = df.groupBy(*by).agg(F.sum("n").alias("_n"), F.sum("k").alias("_k"), F.count(F.lit(1)).alias("_g"),
                            F.sum(sq).cast("double").alias("_q"),
                            F.sum(F.col("n").cast("decimal(18,0)") * F.col("n").cast("decimal(18,0)")).cast("double").alias("_nn"))
    p = F.col("_k") / F.col("_n").cast("double")
    between = F.col("_q") - F.col("_k") * p - (F.col("_g") - 1) * p * (1 - p)
    room = F.col("_n") - F.col("_nn") / F.col("_n")
    v = between / room
    s = F.when((room > 0) & (v > 0), p * (1 - p) / v - 1).otherwise(F.lit(STRENGTH[1]))
    return a.select(*by, F.greatest(F.lit(STRENGTH[0]), F.least(F.lit(STRENGTH[1]), s)).alias("_s"))


def reputation(outcomes: DataFrame, host: str = "host", bad: str = "bad", suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Per host: ``host, n_labelled, n_bad, mean, lower`` of the posterior bad rate.

    Rows with a null outcome do not count. Hosts are counted with partial sums (a hot host is one
    row per task) and written, so that the outcomes are worked out once; domains and suffixes are
    summed from the hosts.
    """
    known = outcomes.where(F.col(bad).isNotNull())
    hosts = known.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(bad).cast("long")).alias("k"))
    domain, suffix = domain_of(F.col("host"), suffixes)
    hosts = materialize(hosts).withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    top = suffixes.agg(F.sum("n").alias("_an"), F.sum("k").alias("_ak"))
    one = F.lit(1).alias("_one")
    s_top = _strength(suffixes.select("*", one), ["_one"]).select(F.col("_s").alias("_s0"))
    # The total is one row: broadcasts of fixed size.
    base = suffixes.join(F.broadcast(top)).join(F.broadcast(s_top))
    base = base.select("suffix", ((F.col("k") + F.col("_s0") * (F.col("_ak") + 0.5) / (F.col("_an") + 1.0)) / (F.col("n") + F.col("_s0"))).alias("_m1"))
    base = base.join(_strength(domains, ["suffix"]).withColumnRenamed("_s", "_s1"), "suffix")
    level = salted_join(domains, base, "suffix", how="inner")
    level = level.select("domain", ((F.col("k") + F.col("_s1") * F.col("_m1")) / (F.col("n") + F.col("_s1"))).alias("_m2"))
    level = level.join(_strength(hosts, ["domain"]).withColumnRenamed("_s", "_s2"), "domain")
    out = salted_join(hosts, level, "domain", how="inner")
    a = F.col("k") + F.col("_s2") * F.col("_m2")
    t = F.col("n") + F.col("_s2")
    mean = a / t
    lower = mean - F.lit(Z) * F.sqrt(mean * (1 - mean) / (t + 1))
    return out.select("host", F.col("n").alias("n_labelled"), F.col("k").alias("n_bad"), mean.alias("mean"), lower.alias("lower"))


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` from (verdict, host, path) rules.

    A rule fits its host and every subdomain when the path starts with the rule's path; the
    longest (host and path together) wins, ties by the text of the rule. A rule's empty path is
    written without a slash, ``/`` as ``net/``.
    """
    rule = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return df.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], url: str = "url",
                bad_rate: float = BAD_RATE, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """Columns of ``pages`` and ``host, path, rule, verdict, bad_rate, bad_rate_lower``.

    ``outcomes`` has ``host`` and ``bad`` (0, 1 or null). Without a fitting rule a page is
    blocked when its host's lower bound is at least ``bad_rate``; a host without outcomes, and
    the empty host of a null or malformed url, is judged by its counts alone like any other
    (allowed if it has none). Repeated rows are judged alike; columns of ``pages`` with the
    names of the added ones are replaced. The join to the reputations is salted, so a host
    with a third of the pages is spread.
    """
    added = ("host", "path", "rule", "verdict", "rule_verdict", "bad_rate", "bad_rate_lower")
    judged = apply_rules(split_url(pages.drop(*added), url), rules)
    rep = reputation(outcomes, suffixes=suffixes).select("host", F.col("mean").alias("bad_rate"), F.col("lower").alias("bad_rate_lower"))
    out = salted_join(judged, rep, "host")
    own = F.when(F.col("bad_rate_lower") >= bad_rate, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("rule_verdict", own)).drop("rule_verdict")


#: The rules of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Outcomes from the pages themselves: bad when over 1 % of the html are junk symbols."""
    junk = F.length("html") - F.length(F.translate("html", "#$%*", ""))
    return split_url(pages).select("host", F.when(F.col("html").isNotNull(), (junk * 100 > F.length("html")).cast("int")).alias("bad"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    out = filter_urls(pages.select("page_id", "url"), page_outcomes(pages), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def _strength_sql(source: str, by: str) -> str:
    lo, hi = STRENGTH
    return f"""SELECT {by}, greatest({lo}, least({hi}, CASE WHEN room > 0 AND v > 0 THEN p * (1 - p) / v - 1 ELSE {hi} END)) AS s FROM (
      SELECT *, (q - k * p - (g - 1) * p * (1 - p)) / room AS v FROM (
        SELECT *, k / CAST(n AS DOUBLE) AS p, n - nn / n AS room FROM (
          SELECT {by}, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, count(*) AS g,
                 CAST(sum(CAST(round(CAST(k AS DOUBLE) * k / n, 9) AS DECIMAL(28, 9))) AS DOUBLE) AS q,
                 CAST(sum(CAST(n AS HUGEINT) * n) AS DOUBLE) AS nn
          FROM {source} GROUP BY {by})))"""


_REST = "CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1, 's') ELSE '' END"
_LAST = {n: "regexp_extract(host, '([^.]*" + r"\.[^.]*" * (n - 1) + ")$', 1)" for n in (2, 3)}
_DOUBLE = "regexp_extract(host, '([^.]*\\.[^.]*)$', 1) IN (" + ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES) + ")"

OP4_SQL = f"""
WITH cut AS (SELECT page_id, html, coalesce({_REST}, '') AS rest FROM pages),
split AS (
  SELECT page_id, html, split_part(rest, '/', 1) AS h, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM cut),
parts AS (SELECT page_id, html, translate(h, '{UPPER}', '{LOWER}') AS host, path FROM split),
outcomes AS (
  SELECT host, CAST((length(html) - length(translate(html, '#$%*', ''))) * 100 > length(html) AS INTEGER) AS bad
  FROM parts WHERE html IS NOT NULL),
hosts0 AS (SELECT host, count(*) AS n, CAST(sum(bad) AS BIGINT) AS k FROM outcomes GROUP BY host),
hosts AS (
  SELECT *, CASE WHEN {_DOUBLE} THEN coalesce(nullif({_LAST[3]}, ''), host) ELSE coalesce(nullif({_LAST[2]}, ''), host) END AS domain,
         CASE WHEN {_DOUBLE} THEN {_LAST[2]} ELSE regexp_extract(host, '([^.]*)$', 1) END AS suffix FROM hosts0),
domains AS (SELECT domain, suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, CAST(sum(n) AS BIGINT) AS n, CAST(sum(k) AS BIGINT) AS k, 1 AS one FROM domains GROUP BY suffix),
top AS (SELECT CAST(sum(n) AS BIGINT) AS an, CAST(sum(k) AS BIGINT) AS ak FROM suffixes),
s0 AS ({_strength_sql('suffixes', 'one')}),
s1 AS ({_strength_sql('domains', 'suffix')}),
s2 AS ({_strength_sql('hosts', 'domain')}),
m1 AS (SELECT suffix, (k + s0.s * (ak + 0.5::DOUBLE) / (an + 1.0::DOUBLE)) / (n + s0.s) AS m FROM suffixes, top, s0),
m2 AS (SELECT domain, (k + s1.s * m1.m) / (n + s1.s) AS m FROM domains JOIN m1 USING (suffix) JOIN s1 USING (suffix)),
post AS (SELECT host, k + s2.s * m2.m AS a, n + s2.s AS t FROM hosts JOIN m2 USING (domain) JOIN s2 USING (domain)),
rep AS (SELECT host, a / t - {Z} * sqrt(a / t * (1 - a / t) / (t + 1)) AS low FROM post),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN low >= {BAD_RATE} THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN rep USING (host)
"""
