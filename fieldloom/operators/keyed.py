"""Keyed comparison, merging, mapping and lookups between tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(server: DataFrame, local: DataFrame, keys: list[str], value: str = "text") -> DataFrame:
    """``keys, server_text, local_text, diff``: Match, Server-Only, Local-Only, Server-Empty, Conflict.

    Server-Empty (there on both sides, empty on the server only) is told before Conflict.
    """
    s = server.select(*keys, F.col(value).alias("server_text"), F.lit(True).alias("_s"))
    l = local.select(*keys, F.col(value).alias("local_text"), F.lit(True).alias("_l"))
    both = s.join(l, keys, "full_outer")
    st, lt = F.coalesce("server_text", F.lit("")), F.coalesce("local_text", F.lit(""))
    kind = (F.when(F.col("_l").isNull(), "Server-Only").when(F.col("_s").isNull(), "Local-Only").when(st == lt, "Match")
            .when(st == "", "Server-Empty").otherwise("Conflict"))
    return both.withColumn("diff", kind).drop("_s", "_l")


def resolve(compared: DataFrame, mode: str) -> DataFrame:
    """Adds ``result`` and ``action``. ``report-only`` changes nothing; ``server-wins`` adds and
    overwrites, keeping local text where the server has none; ``local-wins`` plans writes."""
    d = F.col("diff")
    if mode == "server-wins":
        result = F.when(d.isin("Server-Only", "Conflict"), F.col("server_text")).otherwise(F.col("local_text"))
        action = F.when(d == "Server-Only", "add").when(d == "Conflict", "overwrite").otherwise("keep")
    elif mode == "local-wins":
        result = F.coalesce("local_text", "server_text")
        action = F.when(d.isin("Local-Only", "Conflict", "Server-Empty"), "write-server").otherwise("keep")
    elif mode == "report-only":
        result, action = F.col("local_text"), F.lit("report")
    else:
        raise ValueError(mode)
    return compared.withColumn("result", result).withColumn("action", action)


def seed(wanted: DataFrame, existing: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds ``action``: insert, skip (same value there) or conflict (another one; never overwritten)."""
    e = existing.select(*keys, F.col(value).alias("_there"), F.lit(True).alias("_e"))
    action = F.when(F.col("_e").isNull(), "insert").when(F.col("_there").eqNullSafe(F.col(value)), "skip").otherwise("conflict")
    return wanted.join(e, keys, "left").withColumn("action", action).drop("_e", "_there")


def one_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given (an ascending sequence: first wins; descending: last)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def config_merge(template: DataFrame, target: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """``key, value, state``: existing values are kept, missing keys added, deprecated ones reported."""
    added = template.join(target, key, "left_anti").select(key, value, F.lit("added").alias("state"))
    kept = target.join(template, key, "left_semi").select(key, value, F.lit("kept").alias("state"))
    old = target.join(template, key, "left_anti").select(key, value, F.lit("deprecated").alias("state"))
    return added.unionByName(kept).unionByName(old)


def verify_targets(sources: DataFrame, targets: DataFrame, name: str, suffix: str) -> DataFrame:
    """Each name of ``sources`` with whether ``name-suffix`` is among the targets (of several spellings the least)."""
    t = targets.groupBy(F.upper(name).alias("_t")).agg(F.min(name).alias("target_name"))
    s = sources.groupBy(name).agg(F.count(F.lit(1)).alias("records"))
    return s.join(t, F.upper(F.concat(F.col(name), F.lit(f"-{suffix}"))) == F.col("_t"), "left").select(
        name, "records", "target_name", F.col("target_name").isNotNull().alias("verified"))


def upsert_plan(wanted: DataFrame, sources: DataFrame, existing: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """``key, outcome``: missing-source, exists, or save."""
    s, e = sources.select(key, F.lit(True).alias("_s")).distinct(), existing.select(key, F.lit(True).alias("_e")).distinct()
    df = wanted.select(key).join(s, key, "left").join(e, key, "left")
    there = F.col("_e").isNotNull() if not overwrite else F.lit(False)
    return df.select(key, F.when(F.col("_s").isNull(), "missing-source").when(there, "exists").otherwise("save").alias("outcome"))


def map_codes(codes: DataFrame, systems: DataFrame, dictionaries: DataFrame, pairs: DataFrame, reverse: bool = False) -> DataFrame:
    """``codes`` (system, dict, code) with ``mapped`` and ``mapped_name``, over three tables.

    ``systems``: system_id, system; ``dictionaries``: dict_id, system_id, dict; ``pairs``: dict_id,
    hiscode, hisname, extcode, extname, his_flag, is_deleted. ``reverse`` maps from outside.
    """
    p = pairs.where("coalesce(is_deleted, 'N') <> 'Y'").join(dictionaries, "dict_id").join(systems, "system_id")
    a, b, n = ("extcode", "hiscode", "hisname") if reverse else ("hiscode", "extcode", "extname")
    p = p.groupBy("system", "dict", F.col(a).alias("code")).agg(F.min(F.struct(F.col(b).alias("mapped"), F.col(n).alias("mapped_name"))).alias("_m"))
    return codes.join(p, ["system", "dict", "code"], "left").select(*codes.columns, "_m.mapped", "_m.mapped_name")


def merged(parent: DataFrame, children: DataFrame, extensions: list[DataFrame], key: str) -> DataFrame:
    """Children with their parent (both needed) and 1:1 extension rows where they exist."""
    out = children.join(parent, key)
    for e in extensions:
        out = out.join(e, [c for c in e.columns if c in out.columns], "left")
    return out


def chain(start: DataFrame, steps: list[tuple[DataFrame, str]], tenant: str | None = None) -> DataFrame:
    """Lookup after lookup; with ``tenant`` every step must agree on that column too."""
    for table, key in steps:
        start = start.join(table, [key, tenant] if tenant and key != tenant else [key])
    return start


def ranges(df: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """Left join to ``bands`` (lo, hi, band) by lo <= value <= hi. Bands are a short list."""
    return df.join(bands, (F.col(value) >= F.col("lo")) & (F.col(value) <= F.col("hi")), "left").drop("lo", "hi")


def longest_prefix(df: DataFrame, path: str, roots: list[tuple[str, str]], default: str) -> Column:
    """Mode of the longest root that is the path or above it; a column for ``df``."""
    out = F.lit(default)
    for root, mode in sorted(roots, key=lambda r: (len(r[0]), r[0])):
        out = F.when((F.col(path) == root) | F.col(path).startswith(f"{root}/"), mode).otherwise(out)
    return out


def longest_root(df: DataFrame, path: str, roots: DataFrame, key: list[str], separator: str = "/") -> DataFrame:
    """``df`` with ``root`` and ``mode`` of the longest root that is the path or above it; nulls where none is.

    ``roots``: root, mode. Each path is exploded into itself and what is above it, which join the roots by equality, so the
    table of roots may be of any size. ``key`` names the columns that tell ``df``'s rows apart. Of a root that is given
    more than once, the least mode counts; a null path has no root. Roots end without a separator.
    """
    one = roots.where("root is not null").groupBy("root").agg(F.min("mode").alias("mode"))
    parts = F.split(F.col(path), F.lit(f"\\Q{separator}\\E"), -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))
    tried = df.where(F.col(path).isNotNull()).select(*key, F.explode(F.array_distinct(above)).alias("root"))
    best = tried.join(one, "root").groupBy(*key).agg(F.max_by(F.struct("root", "mode"), F.length("root")).alias("_best"))
    return df.join(best, key, "left").select(*df.columns, F.col("_best.root").alias("root"), F.col("_best.mode").alias("mode"))


def first_capability(offers: DataFrame) -> DataFrame:
    """Per capability one plugin: required before optional, then by visit order."""
    return one_per_key(offers, ["capability"], [F.when(F.col("kind") == "required", 0).otherwise(1), F.col("visit")])


def path_fallback(wanted: DataFrame, nested: DataFrame, root: DataFrame, key: str) -> DataFrame:
    """The nested path of a name, else its root path, else its name below ``nested``."""
    n, r = nested.select(key, F.col("path").alias("_n")), root.select(key, F.col("path").alias("_r"))
    return wanted.join(n, key, "left").join(r, key, "left").select(
        *wanted.columns, F.coalesce("_n", "_r", F.concat(F.lit("nested/"), F.col(key))).alias("path"))


def index_states(expected: DataFrame, existing: DataFrame, key: str = "path") -> DataFrame:
    """``path, state`` of generated files: missing, stale, unchanged, conflict (made by hand), removed."""
    a = expected.select(key, F.col("content").alias("_want"))
    b = existing.select(key, F.col("content").alias("_have"), F.col("generated").alias("_gen"))
    df = a.join(b, key, "full_outer")
    state = (F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), F.when(F.col("_gen"), "removed").otherwise("foreign"))
             .when(~F.col("_gen"), "conflict").when(F.col("_want") == F.col("_have"), "unchanged").otherwise("stale"))
    return df.select(key, state.alias("state"))


def distinct_names(lists: DataFrame, names: str, seq: str) -> DataFrame:
    """Names of comma-separated lists, trimmed, blanks dropped, each once (whatever its case) with
    its first place and spelling."""
    one = lists.select(seq, F.posexplode(F.split(names, ",")).alias("_at", "_name")).withColumn("_name", F.trim("_name")).where("_name <> ''")
    return one.groupBy(F.lower("_name").alias("name_key")).agg(F.min(F.struct(F.col(seq), F.col("_at"), F.col("_name"))).alias("_f")).select(
        F.col("_f._name").alias("name"), F.col(f"_f.{seq}").alias("first_seq"))


def set_check(have: Column, want: Column) -> tuple[Column, Column]:
    """(missing, unsupported) elements."""
    return F.array_sort(F.array_except(want, have)), F.array_sort(F.array_except(have, want))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.trim(F.coalesce(status, F.lit(""))) != "").groupBy(status).agg(F.count(F.lit(1)).alias("n")).orderBy(status)


def pivot_counts(df: DataFrame, keys: list[str], column: str, values: list[str]) -> DataFrame:
    """Counts of each of a fixed list of values per key."""
    return df.groupBy(*keys).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def checked_parameters(df: DataFrame, required: list[str], message: str = "missing parameters") -> DataFrame:
    """Rows with ``error_code, error``: -1 and the names of the required columns that are null or blank, or 0
    and null; a row with an error has no other data."""
    missing = F.filter(F.array(*[F.when(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())
    bad = F.size(missing) > 0
    kept = [F.when(~bad, F.col(c)).alias(c) for c in df.columns]
    return df.select(*kept, F.when(bad, -1).otherwise(0).alias("error_code"), F.when(bad, F.concat(F.lit(f"{message}: "), F.array_join(missing, ", "))).alias("error"))


def where_given(df: DataFrame, required: dict[str, object], optional: dict[str, object]) -> DataFrame:
    """Rows equal to all required values and to those optional values that are not None."""
    missing = [k for k, v in required.items() if v in (None, "")]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    for k, v in {**required, **optional}.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df


def schedule_page(df: DataFrame, required: dict[str, object], optional: dict[str, object], period: tuple[str, object, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row ``n`` with the number of rows, the rows) equal to all required and the given optional values and, with ``period``
    (column, first day, last day), within these days; a day that is None is open."""
    rows = where_given(df, required, optional)
    if period:
        day, first, last = F.to_date(period[0]), period[1], period[2]
        rows = rows.where((day >= F.lit(first)) if first is not None else F.lit(True)).where((day <= F.lit(last)) if last is not None else F.lit(True))
    return rows.agg(F.count(F.lit(1)).alias("n")), rows


def period_report(df: DataFrame, keys: list[str], status: str, values: list[str], day: str, first=None, last=None, tenant: tuple[str, object] | None = None) -> DataFrame:
    """Counts of each of a fixed list of states per key, of the rows from ``first`` to ``last`` (both today by default) and, with
    ``tenant`` (column, value), of that tenant only. A report for a tenant that is None is refused: it would show all tenants' rows."""
    if tenant and tenant[1] is None:
        raise ValueError("no tenant given")
    rows = df.where(F.to_date(day).between(F.coalesce(F.lit(first).cast("date"), F.current_date()), F.coalesce(F.lit(last).cast("date"), F.current_date())))
    rows = rows.where(F.col(tenant[0]) == F.lit(tenant[1])) if tenant else rows
    return pivot_counts(rows, keys, status, values)


def first_by(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key, with ``place`` from 1, by the columns ``order``: ascending, nulls last."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.asc_nulls_last(c) for c in order]))
    return df.withColumn("place", place).where(F.col("place") <= n)


def any_of(df: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows that meet any of the conditions, each once, as a union of scans that each filter by one condition and none before it. Each
    scan's filter can be pushed down or use its own partitions, which a filter with OR can't."""
    out, before = None, F.lit(False)
    for c in conditions:
        c = F.coalesce(c, F.lit(False))
        rows = df.where(c).where(~before)
        out, before = rows if out is None else out.union(rows), before | c
    return out


def whitespace_shares(diffs: DataFrame, lines: int = 80, share: float = 0.7) -> DataFrame:
    """Adds ``ratio`` and ``verdict`` from ``normal`` and ``ignoring`` (white space) changed-line counts."""
    ratio = F.when(F.col("normal") > 0, (F.col("normal") - F.col("ignoring")) / F.col("normal")).otherwise(0.0)
    verdict = (F.when((F.col("normal") > 0) & (F.col("ignoring") == 0), "whitespace-only")
               .when((F.col("normal") >= lines) & (ratio >= share), "formatting-heavy").otherwise("ok"))
    return diffs.withColumn("ratio", ratio).withColumn("verdict", verdict)
