"""Dependency graphs: closure and order, by joins that run until nothing is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.shared import Steps

#: Stored steps that are read together before they are written as one.
COMPACT = 8
#: Levels of a closure in a row that may hold pairs of levels before; in a graph with cycles each is at most as large as the closure.
OPEN = 3


class _Seen:
    """A growing table of kept steps, written as one when there are many; the parts are removed then."""

    def __init__(self, steps: Steps, first: DataFrame) -> None:
        self.steps, self.parts = steps, [first]

    @property
    def df(self) -> DataFrame:
        return reduce(DataFrame.union, self.parts)

    def add(self, new: DataFrame) -> None:
        self.parts.append(new)
        if len(self.parts) >= COMPACT:
            whole = self.steps.keep(self.df)
            self.steps.drop(*[p for p in self.parts if p is not new])  # the newest is still read as the next level's start
            self.parts = [whole]


def _keys(installed: DataFrame) -> DataFrame:
    """``_key, _rank, _name``: what each module of ``name, folder`` may be called, in lower case; names go before folders."""
    called = F.array(*[F.struct(F.lower(F.trim(c)).alias("_key"), F.lit(rank).alias("_rank")) for rank, c in enumerate(("name", "folder"))])
    return installed.select(F.col("name").alias("_name"), F.explode(called).alias("_k")).select("_k._key", "_k._rank", "_name").where("_key <> ''")


def as_installed(df: DataFrame, column: str, installed: DataFrame) -> DataFrame:
    """The rows whose ``column`` calls a module of ``installed`` (``name, folder``) by its name or else by its folder, in any case, now by the
    module's own name. Others, blanks and nulls are left out; of several modules called alike the first by name counts."""
    known = _keys(installed).groupBy("_key").agg(F.min(F.struct("_rank", "_name")).alias("_best"))
    found = df.join(known, F.lower(F.trim(column)) == F.col("_key"))
    return found.withColumn(column, F.col("_best._name")).select(df.columns)


def starts(installed: DataFrame, profile: DataFrame, asked: DataFrame | None = None, default: str | None = None) -> DataFrame:
    """``name`` of the modules of ``installed`` (``name, folder``) that a closure starts from: those ``asked`` for (``name``), if that names any; else
    those that ``profile`` (``key, state``) enables by name or folder; with an empty profile, the ``default``, if it is installed."""
    asked = None if asked is None else asked.select("name").where("trim(name) <> ''")
    if asked is not None and not asked.isEmpty():
        return as_installed(asked, "name", installed).distinct()
    if profile.isEmpty():
        return installed.where(F.lower("name") == F.lower(F.lit(default))).select("name").distinct()
    enabled = profile.where(F.lower(F.trim("state")) == "enabled").select(F.lower(F.trim("key")).alias("_key"))
    return _keys(installed).join(enabled, "_key", "left_semi").select(F.col("_name").alias("name")).distinct()


def closure(edges: DataFrame, starts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``start, name, depth``: what each start reaches over ``name -> depends_on``, itself at depth
    0, each name once at its least depth. Cycles end; names without edges are kept as leaves. With ``known``
    (name), names that are not there are left out, starts as well, and nothing is reached over them. It ends when a level brings nothing new, however many levels there are."""
    steps = Steps(edges.sparkSession)
    e = edges.select(F.col("name").alias("_from"), F.col("depends_on").alias("_to")).distinct()
    if known is not None:
        names = known.select("name").distinct()
        e = e.join(names, e["_to"] == names["name"], "left_semi")
        starts = starts.join(names, "name", "left_semi")
    e = steps.keep(e)
    new = steps.keep(starts.select(F.col("name").alias("start"), F.col("name"), F.lit(0).alias("depth")).distinct())
    seen, depth, last = _Seen(steps, new), 0, new.count()
    whole, open_rows, open_levels, again = last, 0, 0, False
    while last:
        depth += 1
        step = new.join(e, F.col("name") == F.col("_from")).select("start", F.col("_to").alias("name"), F.lit(depth).alias("depth")).distinct()
        # What was seen before is taken out only where that costs no more than the levels since then; the least depth is told at the end.
        if open_rows + last >= whole or open_levels == OPEN:
            step, open_rows, open_levels = step.join(seen.df.select("start", "name"), ["start", "name"], "left_anti"), 0, -1
        else:
            again = True
        new = steps.keep(step)
        last = new.count()
        whole, open_rows, open_levels = whole + last, open_rows + last if open_levels >= 0 else 0, open_levels + 1
        seen.add(new)
    steps.drop(e)
    return seen.df.groupBy("start", "name").agg(F.min("depth").alias("depth")) if again else seen.df


def levels(edges: DataFrame) -> DataFrame:
    """``name, level``: leaves have level 0, others one more than the highest they depend on; null
    for names on or above a cycle. Ordering by level puts leaves first."""
    steps = Steps(edges.sparkSession)
    e = steps.keep(edges.select("name", "depends_on").distinct())
    names = steps.keep(e.select("name").union(e.select("depends_on")).distinct())
    ready = steps.keep(names.join(e.select("name").distinct(), "name", "left_anti").withColumn("level", F.lit(0)))
    done, left, level = _Seen(steps, ready), e, 0
    while not ready.isEmpty():
        level += 1
        # Edges to what has just got its level are done with; a name without edges left is next.
        rest = steps.keep(left.join(ready.select(F.col("name").alias("depends_on")), "depends_on", "left_anti"))
        ready = steps.keep(left.select("name").distinct().join(rest.select("name").distinct(), "name", "left_anti").withColumn("level", F.lit(level)))
        steps.drop(left)
        left = rest
        done.add(ready)
    steps.drop(left)
    return names.join(done.df, "name", "left")


def removal_order(edges: DataFrame, target: str | int) -> DataFrame:
    """``name, level`` of what ``target`` depends on, leaves first, without the target; and ``in_cycle`` for
    the names that have no level, which a warning is due for."""
    starts = edges.sparkSession.createDataFrame([(target,)], "name " + edges.schema["name"].dataType.simpleString())
    below = closure(edges, starts).select("name")
    own = edges.join(below, "name", "left_semi")
    out = levels(own).where(F.col("name") != F.lit(target))
    return out.withColumn("in_cycle", F.col("level").isNull())
