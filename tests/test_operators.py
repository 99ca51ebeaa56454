import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text as T
from fieldloom.operators import encodings, graph, intervals, keyed, manifest, slow_calls, traces, updates
from fieldloom.sources import documents, texts


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(expr.alias("x")).first().x


def test_slow_calls(spark, tmp_path):
    messages = [("接口[com.vendor.his.ipcare.a.B#m(x)] 耗时：61000ms", "t1"), ("接口[com.vendor.his.ipcare.a.B#m(y)] 耗时:61000ms", "t2"),
                ("接口[com.vendor.hos.c.D.n] 耗时：30000", "t3"), ("no marker", "t4"), ("接口[other.E.p(q)]", "t5")]
    nested = [{"message": {"full_message": m, "timestamp": "2024", "traceId": t}} if i % 2 else {"full_message": m, "timestamp": "2024", "traceId": t} for i, (m, t) in enumerate(messages)]
    (tmp_path / "log.json").write_text(json.dumps({"total_results": 9, "messages": nested}), encoding="utf-8")
    log = texts.log_export(spark, str(tmp_path / "log.json"))
    out = {r.full_name: r for r in slow_calls.stats(slow_calls.calls(log), "vendor").collect()}
    assert len(out) == 3
    b = out["com.vendor.his.ipcare.a.B#m"]
    assert (b.calls, b.max_ms, b.max_trace, b.product_group, b.severity) == (2, 61000, "t1", "医生站", "high")
    assert (out["com.vendor.hos.c.D.n"].product_group, out["com.vendor.hos.c.D.n"].severity) == ("HOS平台", "low")
    e = out["other.E.p"]
    assert (e.max_ms, e.max_trace, e.product_group, e.severity) == (0, "", "其他", "low")
    assert slow_calls.envelope(log).first().sampled == 5


def test_text(spark):
    assert one(spark, T.column_index(F.col("a")), a="AB12") == 27
    assert one(spark, T.trim_empty(F.col("a")), a=["x", "", "y", " ", ""]) == ["x", "", "y"]
    assert one(spark, T.slug(F.col("a")), a=" A b/接口--.") == "a-b-接口"
    assert one(spark, T.chunks(F.col("a")), a="x" * 13001) == ["x" * 6000, "x" * 6000, "x" * 1001]
    assert one(spark, T.relaxed_map(F.col("a")), a="{k:v,x:y}") == {"k": "v", "x": "y"}
    assert one(spark, T.placeholders(F.col("a")), a="%1 {0} ${n}") == sorted(["%1", "{0}", "${n}"])
    assert one(spark, T.redaction_classes(F.col("a")), a="at 10.0.0.1 token=abc") == ["IPv4 address", "secret or connection assignment"]
    assert one(spark, T.cjk_attributes(F.col("a")), a='<a x="中" y="b"/>') == 1
    assert one(spark, T.changed_lines(F.col("a")), a="--- a\n+++ b\n-x\n+y\n z") == 2
    assert one(spark, T.data_shape(F.col("a")), a='{"a":1}') == "json"
    assert one(spark, T.piece(F.col("a"), 2), a="x^y^z") == "y" and one(spark, T.piece(F.col("a"), 9), a="x") == ""
    assert one(spark, T.is_read_sql(F.col("a")), a=" WITH x") is True


def test_writes_denies_by_default(spark):
    df = spark.createDataFrame([("list", {}), ("save", {}), ("query", {"mode": "read"}), ("query", {"sql": "delete"}), ("query", {"sql": "select 1"})], "tool string, args map<string,string>")
    assert [r.w for r in df.select(T.writes(F.col("tool"), F.col("args"), ("list",)).alias("w")).collect()] == [False, True, False, True, False]


def test_encodings(spark):
    data = [("ascii", b"abc"), ("utf8", "中文é😀".encode()), ("gb2312", "中文".encode("gb2312")), ("unknown", b"\xff\xfea\x00"), ("ascii", b"")]
    df = spark.createDataFrame([(str(i), c) for i, (_, c) in enumerate(data)], "path string, content binary")
    assert [r.encoding for r in encodings.detect(df).orderBy("path").collect()] == [k for k, _ in data]
    r = encodings.recode(df).orderBy("path").collect()
    assert r[0].error is None and r[1].error == "UnicodeEncodeError" and r[1].recoded is None
    roots = spark.createDataFrame([("a", "1", "utf8"), ("a", "2", "gb2312"), ("b", "1", "ascii")], "root string, path string, encoding string")
    assert {r.root: r.verdict for r in encodings.root_verdict(roots).collect()} == {"a": "mixed", "b": "insufficient"}


def test_graph_with_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "e")], "name string, depends_on string")
    out = {(r.name, r.depth) for r in graph.closure(e, spark.createDataFrame([("a",)], "name string")).collect()}
    assert out == {("a", 0), ("b", 1), ("c", 2)}
    lv = {r.name: r.level for r in graph.levels(e).collect()}
    assert lv == {"a": None, "b": None, "c": None, "d": 1, "e": 0}


def t(minute):
    return dt.datetime(2024, 1, 1, 10, minute)


def test_parallel_gate(spark):
    df = spark.createDataFrame([("r", t(2), t(4))] * 3, "run_id string, a timestamp, b timestamp")
    r = intervals.parallel_gate(df, ["run_id"], "a", "b").first()
    assert (r.union_s, r.sum_s, r.passes) == (120.0, 360.0, True)


def test_manifest(spark):
    runs = spark.createDataFrame([("r", "1.2", "topic", "multi-agent", False, False, t(0), t(30), "")],
                                 "run_id string, version string, topic string, mode string, retrospective boolean, authorised boolean, started timestamp, completed timestamp, timing_reason string")
    assert [(r.rule, r.subject) for r in manifest.run_issues(runs).collect()] == [("J3", "mode")]
    stages = spark.createDataFrame([("r", s, a, "completed", t(x), t(y)) for s, a, x, y in [
        ("explorer", "e", 0, 1), ("classifier", "c", 1, 2), ("backend-coder", "b1", 2, 4), ("frontend-coder", "b2", 4, 6), ("template-seed", "b2", 6, 8), ("verifier", "b1", 7, 9)]],
        "run_id string, name string, actor string, status string, started timestamp, completed timestamp")
    assert {(r.rule, r.subject) for r in manifest.stage_issues(runs, stages).collect()} == {("J5", "summary")}
    assert [(r.subject, r.message) for r in manifest.order_issues(runs, stages).collect()] == [("verifier", "starts before template-seed completes")]
    assert [r.subject for r in manifest.actor_issues(runs, stages).collect()] == ["verifier"]
    assert [r.rule for r in manifest.efficiency_issues(runs, stages).collect()] == ["J16"]
    attempts = spark.createDataFrame([("r", "explorer", 1, "failed", t(0), t(1)), ("r", "explorer", 3, "suspended", t(0), t(2))],
                                     "run_id string, stage string, attempt int, status string, started timestamp, completed timestamp")
    assert len(manifest.attempt_issues(stages, attempts).collect()) == 3
    actions = spark.createDataFrame(
        [("r", "1.2", "deploy", "running", "", "business-code-deploy", True, False, True, True, False), ("r", "1.0", "old", None, None, None, True, True, True, None, None),
         ("r", "1.2", "done", "completed", "x", "business-code-deploy", True, True, True, True, True), ("r", "1.2", "early", "planned", None, None, False, None, None, False, True)],
        "run_id string, version string, type string, state string, scope string, category string, `write` boolean, authorized boolean, run_authorized boolean, terminal boolean, ready boolean")
    assert sorted((r.subject, r.message) for r in manifest.action_issues(actions).collect()) == [
        ("deploy", "state and terminal flag differ"), ("deploy", "write is not authorised"), ("deploy", "write without scope"), ("early", "ready before the action ended")]
    scopes = spark.createDataFrame([("r", ["a", "b"], t(3), t(2))], "run_id string, checked array<string>, mutated timestamp, verified timestamp")
    assert {r.subject for r in manifest.scope_issues(scopes, ["b", "c"]).collect()} == {"a", "c", "mutated"}
    history = spark.createDataFrame([("r", [("serial", "t", "why"), ("multi-agent", None, "why")])], "run_id string, mode_history array<struct<mode:string,selected_at:string,reason:string>>")
    assert [r.message for r in manifest.run_issues(runs.join(history, "run_id")).collect() if r.rule == "J2"] == ["multi-agent was not chosen at the start", "entry is incomplete"]
    named = stages.withColumn("report", F.lit("10-explorer.md")).withColumn("timing_reason", F.when(F.col("name") == "verifier", "late"))
    assert {(r.rule, r.subject) for r in manifest.stage_issues(runs, named).collect()} == {("J5", "summary"), ("J6", "verifier")} | {("J5", s) for s in manifest.STAGES[1:-1]}
    owned = spark.createDataFrame([("r", "a", "s", "p"), ("r", "b", "s", "p"), ("r", None, "s", "q"), ("r", "a", "s", " ")], "run_id string, actor string, stage string, path string")
    assert {r.message for r in manifest.ownership_issues(owned).collect()} == {"owned by several actors", "entry is incomplete", "path is empty"}
    capabilities = spark.createDataFrame([("r", "x", "degraded", "p", "r"), ("r", "y", "odd", "p", None)], "run_id string, name string, state string, probe string, result string")
    assert {(r.subject, r.message) for r in manifest.capability_issues(capabilities).collect()} == {("y", "entry is incomplete"), ("y", "unknown state")}
    reports = spark.createDataFrame([("r", "x.md", "A" * 300)], "run_id string, name string, content string")
    assert [r.message for r in manifest.redaction_issues(reports).collect()] == ["contains prohibited long Base64 payload"]
    failures = spark.createDataFrame([("r", "s", "payload-compilation", 2, False, ""), ("r", "t", "net", None, False, "x"), ("r", "u", "net", None, True, "lost"), ("r", "v", "net", 5, False, "")],
                                     "run_id string, signature string, category string, retries int, historical boolean, unknown_reason string")
    failures = failures.withColumns({"fallback": F.lit("f"), "result": F.lit("r"), "retrospective": F.lit(True)})
    assert {r.subject for r in manifest.failure_issues(failures).collect()} == {"s", "t"}


def test_deep_graph_and_order(spark):
    """Chains deeper than a hundred levels, and the order in which what a name needs is removed."""
    chain = spark.range(0, 103).select(F.col("id").alias("name"), (F.col("id") + 1).alias("depends_on"))
    assert graph.closure(chain, spark.createDataFrame([(0,)], "name long")).agg(F.max("depth")).first()[0] == 103
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("a", "p"), ("p", "q"), ("q", "p")], "name string, depends_on string")
    assert {(r.name, r.level, r.in_cycle) for r in graph.removal_order(e, "a").collect()} == {("c", 0, False), ("b", 1, False), ("p", None, True), ("q", None, True)}


def test_page_is_refused_beyond_its_size(spark):
    with pytest.raises(ValueError, match="1000"):
        traces.page(spark.range(3), ["id"], 0, 1001)


def test_modules_and_paragraphs(spark, tmp_path):
    for path, text in {"a/pom.xml": "<project><artifactId>one</artifactId></project>", "b/pom.xml": "<project><artifactId>one</artifactId></project>", "c/pom.xml": "<project><artifactId>${x}</artifactId></project>",
                       "c/target/pom.xml": "<project><artifactId>two</artifactId></project>", "d/pom.xml": "<project", "d/other.xml": "<project><artifactId>no</artifactId></project>"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [(r.artifact, r.folder.rsplit("/", 1)[1]) for r in documents.modules(spark, str(tmp_path)).collect()] == [("one", "b")]
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one </w:t><w:t>two</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>end</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    found = documents.paragraphs(documents.files(spark, str(tmp_path / "x.docx")))
    assert [(r.line_no, r.line) for r in found.orderBy("line_no").collect()] == [(0, "one two"), (1, "end")]
    assert documents.markdown(documents.files(spark, str(tmp_path / "x.docx"))).first().markdown == "# x.docx\n\none two\n\nend\n\n## 表格 1\n\n| cell |\n| --- |\n"
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    rows = f"<w:tr>{cell('a|b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr>"
    with zipfile.ZipFile(tmp_path / "y.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>{rows}</w:tbl><w:tbl>{rows}</w:tbl></w:body></w:document>')
    table = "| a\\|b |  |\n| --- | --- |\n| 1 | 2 |"
    assert documents.markdown(documents.files(spark, str(tmp_path / "y.docx"))).first().markdown == f"# y.docx\n\n## 表格 1\n\n{table}\n\n## 表格 2\n\n{table}\n"


def test_xml_text_in_its_encoding(spark):
    data = ["<?xml version='1.0' encoding='gb2312'?><a>中文</a>".encode("gb2312"), "<a>中文</a>".encode(), b"<?xml version='1.0' encoding='odd'?>", b"\xff\xff", None]
    df = spark.createDataFrame(list(enumerate(data)), "i int, content binary")
    out = [r.t for r in df.select("i", texts.xml_text(F.col("content")).alias("t")).orderBy("i").collect()]
    assert out[0].endswith("<a>中文</a>") and out[1:] == ["<a>中文</a>", None, None, None]


def test_updates(spark):
    r = spark.createDataFrame([("p", "t", "config-created"), ("p", "t", "ok"), ("q", "t", None)], "plugin string, target string, status string")
    assert [(x.plugin, x.created, x.missing) for x in updates.config_notes(r).collect()] == [("p", 1, 0)]
    counts, todo = updates.status_summary(r, ["config-created"])
    assert {(x.status, x.n) for x in counts.collect()} == {(None, 1), ("config-created", 1), ("ok", 1)} and todo.count() == 1
    assert [tuple(x) for x in updates.profile_table(spark.createDataFrame([("b", None), ("a", " ")], "name string, v string"), ["name", "v"]).collect()] == [("a", "-"), ("b", "-")]
    files = spark.createDataFrame([("t", "b.js", "web", "b"), ("t", "a.cls", "class", "a")], "target string, path string, kind string, name string")
    assert json.loads(updates.deploy_manifest(files).first().json)["files"][0]["path"] == "a.cls"
    written = spark.createDataFrame([(1, "insert"), (2, "skip")], "id int, action string")
    assert [x.id for x in updates.rollback_keys(written, ["id"]).collect()] == [1]


def test_diff_order_of_classes(spark):
    s = spark.createDataFrame([(1, "a"), (2, ""), (3, "x"), (5, None)], "k int, text string")
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, "y"), (4, "z")], "k int, text string")
    assert {r.k: r["diff"] for r in keyed.diff(s, l, ["k"]).collect()} == {1: "Match", 2: "Server-Empty", 3: "Conflict", 4: "Local-Only", 5: "Server-Only"}


def test_texts(spark):
    text = "---\nname: x\ndesc: a\n  b\nother: c\n---\n- lang： en\n- lang: fr\n| a | b |\n|---|:-:|\n| c | d |\n"
    ls = texts.lines(spark.createDataFrame([("d", text), ("e", "---\nname: y")], "k string, t string"), "k", "t")
    assert [r.cells for r in texts.pipe_rows(ls, "k").orderBy("line_no").collect()] == [["a", "b"], ["c", "d"]]
    assert [(r.name, r.value) for r in texts.settings(ls, "k").collect()] == [("lang", "en")]
    front = texts.front_matter(ls, "k")
    assert {r.k for r in front.collect()} == {"d"}
    assert {r.name: r.value for r in texts.front_matter_fields(front, "k", ["name", "desc"]).collect()} == {"name": "x", "desc": "a b"}
    blocks = texts.status_blocks(spark.createDataFrame([("d", "name : a\nstatus : ok\n\nname : b")], "k string, t string"), "k", "t")
    assert {(r.block, r.name, r.value) for r in blocks.collect()} == {(0, "name", "a"), (0, "status", "ok"), (1, "name", "b")}
    f = texts.feedback_entries(spark.createDataFrame([('{"fields": {"a": {"candidate": "x", "confidence": 0.9}, "b": "y"}}',)], "json string")).orderBy("seq").collect()
    assert [(r.key, r.candidate, r.confidence) for r in f] == [("a", "x", 0.9), ("b", "y", None)]


def test_label_gaps(spark):
    at = [("f", 1, 0.0, 0.0, True, 3.0), ("f", 2, 5.0, 0.2, False, 9.0), ("f", 3, 20.0, 0.1, True, 1.0), ("f", 4, 20.5, 0.0, False, 1.0), ("f", 5, 0.0, 9.0, True, 1.0), ("f", 6, 2.0, 9.0, True, 1.0),
          ("f", 7, 9.0, 9.0, False, 1.0), ("f", 8, 12.0, 9.0, True, None), ("f", 9, 13.0, 9.0, False, 1.0)]
    out = intervals.label_gaps(spark.createDataFrame(at, "form string, id int, xcol double, yrow double, label boolean, width double"), ["form"], "id", "label", "width")
    assert [(r.id, r.space, r.fit) for r in out.orderBy("id").collect()] == [(1, 2.0, "ok"), (2, None, None), (3, -0.5, "overlap"), (4, None, None), (5, None, None), (6, 6.0, "wide"), (7, None, None), (8, None, None), (9, None, None)]


def test_term_table(spark):
    df = spark.createDataFrame([("a.js", "x", None, " ", "n1"), ("a.js", "x", "m", "ex", "n2"), ("a.js", "x", "m", "why", "n3"), ("b.js", None, None, None, None)], "file string, text string, meaning string, translation string, note string")
    assert sorted(tuple(r) for r in updates.term_table(df).collect()) == [("a.js", "", "backend-dict", "x", "m", "ex", "n2"), ("b.js", "", "backend-dict", "", "", "", "")]


def test_starts_of_a_closure(spark):
    installed = spark.createDataFrame([("Core", "core-dir"), ("Kit", "kit-dir"), ("Web", "kit"), ("Log", None)], "name string, folder string")
    profile = spark.createDataFrame([("core-DIR", "Enabled"), ("web", "disabled"), ("gone", "enabled"), (None, "enabled")], "key string, state string")
    names = lambda df: sorted(r.name for r in df.collect())
    asked = spark.createDataFrame([("KIT",), (" ",), (None,), ("kit-dir",), ("gone",)], "name string")
    assert names(graph.starts(installed, profile)) == ["Core"]
    assert names(graph.starts(installed, profile, asked.where("name = ' '"))) == ["Core"]
    assert names(graph.starts(installed, profile, asked)) == ["Kit"]  # a name goes before a folder
    assert names(graph.starts(installed, profile.limit(0), None, "log")) == ["Log"] and names(graph.starts(installed, profile.limit(0))) == []
    edges = graph.as_installed(spark.createDataFrame([("Core", "kit-dir"), ("Kit", "LOG"), ("Kit", "gone"), ("Web", None)], "name string, depends_on string"), "depends_on", installed)
    reached = graph.closure(edges, graph.starts(installed, profile), installed)
    assert {(r.name, r.depth) for r in reached.collect()} == {("Core", 0), ("Kit", 1), ("Log", 2)}
