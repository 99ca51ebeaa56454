"""Validation of run manifests as rows of issues: ``run_id, rule, subject, message``.

Inputs are flat tables keyed by ``run_id``: runs, stages, attempts, owned paths, actions, reports.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import intervals

#: Versions, modes, stages, states and the order of stages.
VERSIONS = ("1.0", "1.1", "1.2")
MODES = ("serial", "multi-agent", "retrospective")
STATUSES = ("completed", "not-applicable", "blocked")
ATTEMPT_STATUSES = ("completed", "blocked", "suspended")
STAGES = ("explorer", "classifier", "backend-coder", "frontend-coder", "template-seed", "verifier", "summary")
ORDER = [("explorer", "classifier"), ("classifier", "backend-coder"), ("classifier", "frontend-coder"), ("classifier", "template-seed"),
         ("backend-coder", "verifier"), ("frontend-coder", "verifier"), ("template-seed", "verifier"), ("verifier", "summary")]
REPORTS = {"explorer": "10-explorer.md", "classifier": "11-classifier.md", "backend-coder": "20-backend-coder.md", "frontend-coder": "21-frontend-coder.md",
           "template-seed": "22-template-seed.md", "verifier": "30-verifier.md", "summary": "40-summary.md"}
SCOPES = ("business-code", "local-i18n-artifacts", "authorized-remote-readback")
CAPABILITIES = ("available", "degraded", "unavailable", "not-required")
REMOTE_STATES, REMOTE_ENDS = ("planned", "running", "suspended", "completed", "skipped", "blocked"), ("completed", "skipped", "blocked")
CATEGORIES = ("translation-data-write", "business-code-deploy", "tool-internal-execution")
COMPILE = ("pass", "not-authorized", "not-applicable")
KEYS = ("schemaVersion", "topic", "runMode", "retrospective", "authorization", "startedAt", "completedAt", "elapsedSeconds", "timingReason", "stages", "failures",
        "qualityGates", "remoteActions")
KEYS_OF = {"1.1": ("modeHistory", "ownership", "lastMutationAt", "verificationRevision"), "1.2": ("modeHistory", "ownership", "capabilities", "finalization", "verification")}
BUILDERS = ("backend-coder", "frontend-coder", "template-seed")


def _issues(df: DataFrame, rule: str, subject, message) -> DataFrame:
    subject, message = (F.lit(x) if isinstance(x, str) else x for x in (subject, message))
    return df.select("run_id", F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), message.alias("message"))


def _checked(df: DataFrame, *checks: tuple) -> DataFrame:
    """The issues of one scan: ``checks`` are (rule, subject, message, condition that is wrong)."""
    def one(rule, subject, message, wrong):
        subject, message = (F.lit(x) if isinstance(x, str) else x for x in (subject, message))
        return F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), message.alias("message")))

    found = F.filter(F.array(*[one(*c) for c in checks]), lambda x: x.isNotNull())
    return df.select("run_id", F.explode(found).alias("_i")).select("run_id", "_i.rule", "_i.subject", "_i.message")


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def run_issues(runs: DataFrame) -> DataFrame:
    """J1 to J4 of a run's own columns; with a column ``mode_history`` (array of mode, reason) its rules too."""
    live = ~F.coalesce(F.col("retrospective"), F.lit(False))
    checks = [
        ("J1", "version", "unsupported version", ~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False))),
        ("J1", "topic", "topic is empty", _blank("topic")),
        ("J2", "mode", "unknown mode", ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False))),
        ("J2", "mode", "mode and retrospective flag differ", (F.col("mode") == "retrospective") != ~live),
        ("J3", "mode", "not authorised", (F.col("mode") == "multi-agent") & ~F.coalesce(F.col("authorised"), F.lit(False))),
        ("J4", "time", "times are missing", (F.col("started").isNull() | F.col("completed").isNull()) & (live | _blank("timing_reason"))),
        ("J4", "time", "ends before it starts", F.col("completed") < F.col("started")),
    ]
    if "mode_history" in runs.columns:
        h = F.coalesce("mode_history", F.array().cast(runs.schema["mode_history"].dataType))
        later = F.col("version").isin("1.1", "1.2")
        half = F.exists(h, lambda e: e["mode"].isNull() | e["selected_at"].isNull() | e["reason"].isNull())
        first = F.coalesce(F.try_element_at(h, F.lit(1))["mode"], F.lit(""))
        checks += [("J2", "mode_history", "mode history is empty", later & (F.size(h) == 0)),
                   ("J2", "mode_history", "multi-agent was not chosen at the start", later & (F.size(h) > 0) & (F.col("mode") == "multi-agent") & (first != "multi-agent")),
                   ("J2", "mode_history", "entry is incomplete", later & half)]
    return _checked(runs, *checks)


def key_issues(keyed: DataFrame, always=KEYS, of_version=KEYS_OF) -> DataFrame:
    """J1: top-level keys that are missing, from ``version`` and ``keys`` (array of those there are)."""
    want = F.array(*[F.lit(k) for k in always])
    for version, keys in of_version.items():
        want = F.concat(want, F.when(F.col("version") == version, F.array(*[F.lit(k) for k in keys])).otherwise(F.array().cast("array<string>")))
    missing = keyed.select("run_id", F.explode(F.array_except(want, F.coalesce("keys", F.array().cast("array<string>")))).alias("_k"))
    return _issues(missing, "J1", F.col("_k"), "required key is missing")


def stage_issues(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """J5 and J6. With a column ``report`` it must be the fixed one of its stage; with ``timing_reason`` a
    live run of version 1.1 or later must leave it empty."""
    rows = F.collect_list(F.struct("name"))  # the few stages of one run
    per_run = runs.select("run_id").join(stages.groupBy("run_id").agg(F.transform(rows, lambda s: s["name"]).alias("_names")), "run_id", "left")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    need = F.array_except(F.array(*[F.lit(s) for s in STAGES]), names)
    twice = F.filter(F.array_distinct(names), lambda n: F.size(F.filter(names, lambda m: m == n)) > 1)
    whole = (per_run.select("run_id", F.explode(F.concat(
        F.transform(need, lambda n: F.struct(n.alias("subject"), F.lit("required stage is missing").alias("message"))),
        F.transform(twice, lambda n: F.struct(n.alias("subject"), F.lit("stage is repeated").alias("message"))))).alias("_i"))
        .select("run_id", F.lit("J5").alias("rule"), "_i.subject", "_i.message"))
    name = F.col("name")
    checks = [
        ("J5", name, "unknown status", ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))),
        ("J6", name, "completed without times", (F.col("status") == "completed") & (F.col("started").isNull() | F.col("completed").isNull())),
        ("J6", name, "ends before it starts", F.col("completed") < F.col("started")),
    ]
    if "report" in stages.columns:
        fixed = F.create_map(*[F.lit(x) for pair in REPORTS.items() for x in pair])[name]
        checks.append(("J5", name, "report has another name", fixed.isNotNull() & ~fixed.eqNullSafe(F.col("report"))))
    if "timing_reason" in stages.columns:
        later = runs.where("version in ('1.1', '1.2') and not coalesce(retrospective, false)").select("run_id", F.lit(True).alias("_later"))
        stages = stages.join(later, "run_id", "left")
        checks.append(("J6", name, "a live run gives a reason for its times", F.col("_later") & ~_blank("timing_reason")))
    return whole.union(_checked(stages, *checks))


def _last_status(tie: tuple[str, ...]) -> Column:
    """The status of the attempt with the highest number; of several the one that starts last, of those the first by ``tie``, then by status."""
    at = F.unix_micros(F.col("started").cast("timestamp"))
    return F.min_by("status", F.struct(F.col("attempt").isNull(), -F.col("attempt"), at.isNull(), -at, *tie, "status"))


def attempt_issues(stages: DataFrame, attempts: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """Sequence, overlap, and agreement of the attempts' span and last status with their stage. ``tie`` orders attempts of one number and start."""
    seq = intervals.attempts(attempts, ["run_id", "stage"], "attempt", "started", "completed", tie)
    span = attempts.groupBy("run_id", "stage").agg(F.min("started").alias("_s"), F.max("completed").alias("_c"), _last_status(tie).alias("_last"))
    both = stages.withColumnRenamed("name", "stage").join(span, ["run_id", "stage"])
    return reduce(DataFrame.union, [
        _issues(seq, "J7", F.col("stage"), F.col("issue")),
        _issues(both.where("_s <> started or _c <> completed"), "J7", F.col("stage"), "attempts and stage differ in their span"),
        _issues(both.where("_last <> status"), "J7", F.col("stage"), "last attempt and stage differ in status"),
    ])


def attempt_rules(runs: DataFrame, stages: DataFrame, attempts: DataFrame, tie: tuple[str, ...] = ()) -> DataFrame:
    """What schema 1.2 asks of attempts beyond ``attempt_issues``: each has its values, a known status, times in order and
    active seconds within them; a stage that applies has one at least, others none; a finished stage doesn't end suspended.

    ``attempts``: run_id, stage, attempt, status, started, completed, active_seconds, reason; ``stages``: run_id, name, status.
    Only runs of version 1.2 are looked at. Attempts of stages that aren't there are looked at too. Of a stage's last attempts with one number
    and start the first by ``tie`` (columns of ``attempts``) counts.
    """
    asked = runs.where("version = '1.2'").select("run_id")
    a = attempts.join(asked, "run_id", "left_semi")
    span = (F.unix_micros(F.col("completed").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))) / F.lit(1e6)
    timed = F.coalesce(span >= 0, F.lit(False))
    each = _checked(a,
                    ("J7", F.col("stage"), "attempt is incomplete", F.col("attempt").isNull() | _blank("status") | F.col("started").isNull() | F.col("completed").isNull()
                     | F.col("active_seconds").isNull() | F.col("reason").isNull()),
                    ("J7", F.col("stage"), "unknown attempt status", ~F.coalesce(F.col("status").isin(*ATTEMPT_STATUSES), F.lit(False))),
                    ("J7", F.col("stage"), "attempt times are invalid", ~timed),
                    ("J7", F.col("stage"), "active seconds are invalid", timed & (F.col("active_seconds").isNull() | (F.col("active_seconds") < 0) | (F.col("active_seconds") > span))))
    ends = a.groupBy("run_id", "stage").agg(F.count(F.lit(1)).alias("_n"), _last_status(tie).alias("_last"))
    named = stages.join(asked, "run_id", "left_semi").select("run_id", F.col("name").alias("stage"), F.col("status").alias("_status"))
    both = named.join(ends, ["run_id", "stage"], "left")
    idle = F.coalesce(F.col("_status") == "not-applicable", F.lit(False))
    per_stage = _checked(both,
                         ("J7", F.col("stage"), "a stage that doesn't apply has attempts", idle & F.col("_n").isNotNull()),
                         ("J7", F.col("stage"), "stage has no attempt", ~idle & F.col("_n").isNull()),
                         ("J7", F.col("stage"), "stage ends with a suspended attempt", F.col("_last") == "suspended"))
    return each.union(per_stage)


def order_issues(runs: DataFrame, stages: DataFrame) -> DataFrame:
    pairs = stages.sparkSession.createDataFrame(ORDER, "before string, after string")
    live = stages.join(runs.where("not coalesce(retrospective, false)").select("run_id"), "run_id", "left_semi")
    bad = intervals.order_violations(live, pairs, ["run_id"])
    return _issues(bad, "J8", F.col("after"), F.concat(F.lit("starts before "), F.col("before"), F.lit(" completes")))


def actor_issues(runs: DataFrame, stages: DataFrame) -> DataFrame:
    builder = F.col("name").isin(*BUILDERS) & (F.col("status") != "not-applicable")
    a = stages.groupBy("run_id").agg(F.countDistinct("actor").alias("actors"), F.countDistinct(F.when(builder, F.col("actor"))).alias("builders"),
                                     F.collect_set(F.when(builder, F.col("actor"))).alias("_b"), F.max(F.when(F.col("name") == "verifier", F.col("actor"))).alias("_v"))
    multi = F.col("mode") == "multi-agent"
    return _checked(a.join(runs.select("run_id", "mode"), "run_id"),
                    ("J9", "actors", "a serial run has one actor", (F.col("mode") == "serial") & (F.col("actors") > 1)),
                    ("J9", "builders", "needs two builders", multi & (F.col("builders") < 2)),
                    ("J9", "verifier", "verifier is not independent", multi & F.array_contains("_b", F.col("_v"))))


def ownership_issues(owned: DataFrame) -> DataFrame:
    """J10 of ``actor, stage, path`` rows: complete, and each path with one actor."""
    half = _checked(owned, ("J10", F.coalesce("path", F.lit("")), "entry is incomplete", F.col("actor").isNull() | F.col("stage").isNull()),
                    ("J10", "path", "path is empty", _blank("path")))
    filled = owned.where(~_blank("path"))
    return half.union(_issues(intervals.ownership_conflicts(filled, ["run_id"]), "J10", F.col("path"), "owned by several actors"))


def scope_issues(scopes: DataFrame, wanted=SCOPES) -> DataFrame:
    """J11: ``checked``, an array of verification scopes, must equal ``wanted`` as a set; where there are the
    columns, the last mutation (``mutated``) must not come after the verifier's start (``verified``)."""
    wanted = F.array(*[F.lit(w) for w in wanted])
    missing, extra = F.array_except(wanted, F.col("checked")), F.array_except(F.col("checked"), wanted)
    checks = [("J11", F.array_join(F.array_sort(missing), ","), "scope was not checked", F.size(missing) > 0),
              ("J11", F.array_join(F.array_sort(extra), ","), "scope is not supported", F.size(extra) > 0)]
    if "mutated" in scopes.columns:
        checks.append(("J11", "mutated", "changed after the verifier's start", F.col("mutated") > F.col("verified")))
    return _checked(scopes, *checks)


def finalization_issues(finals: DataFrame) -> DataFrame:
    """J12: ``ready boolean, checked, verified`` (the verifier's start) of runs of version 1.2: ready, and checked
    before the verifier starts."""
    return _checked(finals, ("J12", "ready", "not ready", ~F.coalesce(F.col("ready"), F.lit(False))),
                    ("J12", "checked", "check time is missing", F.col("checked").isNull()),
                    ("J12", "checked", "checked after the verifier's start", F.col("checked") > F.col("verified")))


def capability_issues(capabilities: DataFrame) -> DataFrame:
    """J12: ``name, state, probe, result`` of each capability."""
    half = F.greatest(*[F.col(c).isNull() for c in ("name", "state", "probe", "result")])
    return _checked(capabilities, ("J12", F.coalesce("name", F.lit("")), "entry is incomplete", half),
                    ("J12", F.coalesce("name", F.lit("")), "unknown state", ~F.coalesce(F.col("state").isin(*CAPABILITIES), F.lit(False))))


def action_issues(actions: DataFrame) -> DataFrame:
    """J13 of ``version, type, write, authorized, run_authorized, scope, category, state, terminal, ready``: a write
    needs the run's and its own consent, from 1.1 on a scope and a category; from 1.2 on the state is one of
    a list, says whether it is final, and is final where the run says it is ready."""
    write, ends = F.coalesce(F.col("write"), F.lit(False)), F.col("state").isin(*REMOTE_ENDS)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    later, latest, kind = F.col("version").isin("1.1", "1.2"), F.col("version") == "1.2", F.coalesce("type", F.lit(""))
    return _checked(actions, ("J13", kind, "write is not authorised", write & ~(yes("authorized") & yes("run_authorized"))),
                    ("J13", kind, "write without scope", later & write & _blank("scope")),
                    ("J13", kind, "write without a known category", later & write & ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))),
                    ("J13", kind, "unknown state", latest & ~F.coalesce(F.col("state").isin(*REMOTE_STATES), F.lit(False))),
                    ("J13", kind, "state and terminal flag differ", latest & (F.coalesce(ends, F.lit(False)) != yes("terminal"))),
                    ("J13", kind, "ready before the action ended", latest & yes("ready") & ~yes("terminal")))


def failure_issues(failures: DataFrame) -> DataFrame:
    """J14 of ``signature, category, retries, historical, unknown_reason, fallback, result, retrospective``: a null
    retry count is for documented history of a retrospective run; a payload's failure is retried once at most."""
    past = F.coalesce(F.col("retrospective") & F.col("historical"), F.lit(False))
    half = F.greatest(*[F.col(c).isNull() for c in ("signature", "category", "historical", "fallback", "result")])
    who = F.coalesce("signature", F.lit(""))
    return _checked(failures, ("J14", who, "record is incomplete", half),
                    ("J14", who, "retry count is missing", F.col("retries").isNull() & ~(past & ~_blank("unknown_reason"))),
                    ("J14", who, "retried more than once", (F.col("category") == "payload-compilation") & (F.col("retries") > 1) & ~past))


def gate_issues(gates: DataFrame) -> DataFrame:
    """J15 of ``handoff, sensitive, compile, structure, residual_risk, xml_triggered, xml`` (array of the four gates of
    XML) of a run's quality gates. What was not compiled needs its structure checked and a word on the risk."""
    passed = lambda c: F.coalesce(F.lower(F.col(c)) == "pass", F.lit(False))
    uncompiled = F.col("compile") == "not-authorized"
    xml = F.coalesce(F.col("xml_triggered"), F.lit(False)) & ~F.coalesce((F.size("xml") == 4) & F.forall("xml", lambda x: F.coalesce(F.lower(x) == "pass", F.lit(False))), F.lit(False))
    return _checked(gates, ("J15", "handoff", "gate is not passed", ~passed("handoff")), ("J15", "sensitive", "gate is not passed", ~passed("sensitive")),
                    ("J15", "compile", "unknown result", ~F.coalesce(F.col("compile").isin(*COMPILE), F.lit(False))),
                    ("J15", "structure", "not compiled and structure not checked", uncompiled & ~passed("structure")),
                    ("J15", "residual_risk", "not compiled and no risk given", uncompiled & _blank("residual_risk")),
                    ("J15", "xml", "gate is not passed", xml))


def efficiency_issues(runs: DataFrame, stages: DataFrame, least_s: int = 60, most: float = 0.75) -> DataFrame:
    """Builders of at least ``least_s`` seconds of a multi-agent run must overlap enough."""
    secs = F.unix_timestamp(F.col("completed").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))
    b = stages.where(F.col("name").isin(*BUILDERS) & (secs >= least_s)).join(runs.where("mode = 'multi-agent'").select("run_id"), "run_id", "left_semi")
    several = b.groupBy("run_id").count().where("count > 1").select("run_id")
    gate = intervals.parallel_gate(b.join(several, "run_id", "left_semi"), ["run_id"], "started", "completed", most)
    return _issues(gate.where("not passes"), "J16", "builders", "builders did not run in parallel")


def redaction_issues(reports: DataFrame) -> DataFrame:
    found = reports.select("run_id", "name", F.explode(T.redaction_classes(F.col("content"))).alias("_class"))
    return _issues(found, "J17", F.col("name"), F.concat(F.lit("contains prohibited "), F.col("_class")))
