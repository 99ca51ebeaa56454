"""Summaries of update and deployment runs: counts by status, by target and by phase."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of configuration files that a summary counts, by the name it shows.
CONFIG = {"missing": "config-missing-key", "merged": "config-merged-key", "deprecated_candidate": "config-deprecated-candidate", "review_required": "config-review-required",
          "missing_file": "config-missing-file", "created": "config-created"}

#: The columns of a table of terms.
TERMS = ("文件名", "入口CSP", "位置/类型", "中文源文案", "占位符语义", "HIS系统最佳目标语言翻译", "备注")


def config_notes(results: DataFrame) -> DataFrame:
    """``plugin, target`` and how many results there are of each state of CONFIG; targets without any are left out."""
    noted = results.where(F.col("status").isin(*CONFIG.values()))
    return noted.groupBy("plugin", "target").agg(*[F.count_if(F.col("status") == s).alias(n) for n, s in CONFIG.items()])


def status_summary(results: DataFrame, actions: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``status, n`` by name, the results whose status needs an action by plugin, target and status)."""
    counts = results.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status")
    return counts, results.where(F.col("status").isin(*actions)).orderBy("plugin", "target", "status")


def phase_totals(results: DataFrame) -> DataFrame:
    """``phase, ok, failed, total, any_failed``: what is not ``ok`` has failed, a missing status too."""
    good = F.coalesce(F.col("status") == "ok", F.lit(False))
    return results.groupBy("phase").agg(F.count_if(good).alias("ok"), F.count_if(~good).alias("failed"), F.count(F.lit(1)).alias("total"), F.bool_or(~good).alias("any_failed"))


def deploy_manifest(files: DataFrame) -> DataFrame:
    """``target, json``: the files of a target (``path, kind, name``) as one JSON object, in order of their paths."""
    listed = files.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("path", "kind", "name"))).alias("files"))
    return listed.select("target", F.to_json(F.struct("target", F.size("files").alias("count"), "files")).alias("json"))


def profile_table(profiles: DataFrame, columns: list[str], by: str = "name") -> DataFrame:
    """The rows by name, blanks as ``-``."""
    blank = lambda c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("-")).alias(c)
    return profiles.select(*[blank(c) for c in columns]).orderBy(by)


def term_table(terms: DataFrame, kind: str = "backend-dict") -> DataFrame:
    """The TERMS columns of ``file, text, meaning, translation, note`` rows: no entry page, all of one ``kind``, missing values empty. A file's
    text has one translation, with what belongs to it: the smallest one that is not blank."""
    blank = F.coalesce(F.trim("translation") == "", F.lit(True))
    best = terms.groupBy("file", "text").agg(F.min(F.struct(blank.alias("blank"), "translation", "meaning", "note")).alias("best"))
    values = [F.col("file"), F.lit(""), F.lit(kind), F.col("text"), F.col("best.meaning"), F.col("best.translation"), F.col("best.note")]
    return best.select(*[F.coalesce(v.cast("string"), F.lit("")).alias(name) for name, v in zip(TERMS, values, strict=True)])


def insert_statements(terms: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """``statement``: an INSERT for each row, quotes doubled, missing values NULL."""
    quoted = [F.coalesce(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")) for c in columns]
    return terms.select(F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *quoted), F.lit(")")).alias("statement"))


def rollback_keys(written: DataFrame, keys: list[str]) -> DataFrame:
    """The keys of the rows that a run inserted, one by one: a rollback never deletes by root."""
    return written.where("action = 'insert'").select(*keys).distinct()
