"""Overlap joins, quiet spans, segmented tables, nested paths, roots and code page 936 against plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.operators import catalogue, encodings, graph, intervals, keyed, manifest, matching, nested, traces
from fieldloom.sources import markup, texts

T0 = dt.datetime(2024, 1, 1)


def spans(rng, n, longest):
    out = [(i, T0 + dt.timedelta(seconds=rng.randrange(100_000)), rng.choice([0, 1, 60, 3600, longest])) for i in range(n)]
    return [(i, a, a + dt.timedelta(seconds=d)) for i, a, d in out]


@pytest.mark.parametrize("hot", [100_000, 5])
@pytest.mark.parametrize("width", [10.0, 3600.0])
def test_overlap_join(spark, hot, width):
    rng = random.Random(1)
    left, right = spans(rng, 150, 90_000), spans(rng, 150, 20_000)
    right += [(900, T0, None), (901, None, T0), (902, T0 + dt.timedelta(hours=2), T0)]
    left += left[:2]
    a = spark.createDataFrame([(i, i % 2, x, y) for i, x, y in left], "a long, k int, a0 timestamp, a1 timestamp")
    b = spark.createDataFrame([(i, i % 2, x, y) for i, x, y in right], "b long, k int, b0 timestamp, b1 timestamp")
    got = intervals.overlap_join(
        a.drop("k"), b.drop("k"), ("a0", "a1"), ("b0", "b1"), width=width, hot=hot)
    want = sorted((i, j) for i, x, y in left for j, u, v in right if u and v and u <= v and x < v and u < y)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    by_key = intervals.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), ("k",), width, hot=hot)
    assert sorted((r.a, r.b) for r in by_key.collect()) == sorted((i, j) for i, j in want if i % 2 == j % 2)
    assert by_key.columns.count("k") == 1
    assert intervals.overlap_join(a.limit(0), b.withColumnRenamed("k", "k2"), ("a0", "a1"), ("b0", "b1")).count() == 0


def test_overlap_join_compares_few_pairs_more(spark):
    rng = random.Random(3)
    at = lambda: T0 + dt.timedelta(seconds=rng.randrange(100_000))
    one, two = ([(i, a, a + dt.timedelta(seconds=rng.choice(d))) for i in range(1500) for a in [at()]] for d in ([10, 50, 200], [100, 400, 800, 9000]))
    a, b = spark.createDataFrame(one, "a long, a0 timestamp, a1 timestamp"), spark.createDataFrame(two, "b long, b0 timestamp, b1 timestamp")
    want = sum(x < v and u < y for _, x, y in one for _, u, v in two)
    compared = intervals._placed(a, b, ("a0", "a1"), ("b0", "b1"), (), 600.0, 8, 100_000, 8).count()
    assert intervals.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), width=600).count() == want <= compared < 2 * want


@pytest.mark.parametrize("lefts, rights, hot", [(1, 400, 20), (400, 1, 20), (400, 400, 50), (200, 200, 5)])
def test_overlap_join_deals_a_bin_of_either_side(spark, lefts, rights, hot):
    end = T0 + dt.timedelta(seconds=5)
    a = spark.createDataFrame([(i, T0, end) for i in range(lefts)], "a long, a0 timestamp, a1 timestamp")
    b = spark.createDataFrame([(i, T0, end) for i in range(rights)], "b long, b0 timestamp, b1 timestamp")
    got = intervals.overlap_join(a, b, ("a0", "a1"), ("b0", "b1"), hot=hot)
    counts = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == got.select("a", "b").distinct().count() == lefts * rights
    assert len(counts) > 2 and max(counts) < 0.7 * lefts * rights


@pytest.mark.parametrize("width, fan", [(1.0, 3), (60.0, 1000), (10**7, 2)])
def test_quiet_spans(spark, width, fan):
    rng = random.Random(2)
    times = [T0 + dt.timedelta(seconds=rng.choice([rng.randrange(3000), rng.randrange(90_000)])) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in times * 2], "ts timestamp").repartition(5)
    ordered = sorted({t for t in times if t})
    want = [(a, b, (b - a).total_seconds()) for a, b in zip(ordered[:-1], ordered[1:], strict=True) if (b - a).total_seconds() >= 200]
    out = intervals.quiet_spans(df, "ts", 200, width, fan)
    assert sorted(map(tuple, out.collect())) == want
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    assert intervals.quiet_spans(df.limit(0), "ts", 1).count() == 0


def grid(spark, rows):
    return spark.createDataFrame([("d", "s", i, r) for i, r in enumerate(rows)], "doc_id string, sheet string, row_idx int, cells array<string>")


def test_mixed_request_and_response(spark):
    head = ["参数名称", "必填", "数据类型", "描述"]
    rows = [["接口名称", "/api/notify/", "", "", ""], ["请求参数（加密前）", *head], ["", "n_type", "Y", "string", "固定格式:PUSH_CLINIC_RESERVATION"],
            ["", "notify_no", "Y", "string", "消息唯一 ID"], ["返回结果", *head], ["", "code", "Y", "INT", "接口调用状态"], ["", "", None, "", ""], ["", "msg", "Y", "String", "描述信息"]]
    out = catalogue.segment_fields(grid(spark, rows)).orderBy("row_idx").collect()
    assert [r.json_path for r in out] == ["request.n_type", "request.notify_no", "response.code", "response.msg"]
    assert {r.interface_title for r in out} == {"PUSH_CLINIC_RESERVATION"} and [r.segment for r in out] == [2, 2, 3, 3]


def test_stored_procedure(spark):
    note = "ph、taker、taketime、takerid为领取麻醉精神药品相关信息"
    rows = [["名称", "patient_list", "patient_list"], ["入参表"] * 3, ["字段名", "数据类型", "字段描述"], ["startdate", "varchar(20)", "开始日期"], ["出参表"] * 3,
            ["字段名", "数据类型", "允许空", "主键", "字段描述", "默认值"], ["hiscode", "varchar(128)", "否", "是", "医院代码", "'0'"], [note, note], ["注：该存储过程", "注：该存储过程"]]
    out = {r.code: r for r in catalogue.segment_fields(grid(spark, rows)).collect()}
    assert set(out) == {"startdate", "hiscode"}
    r = out["hiscode"]
    assert (r.nullable, r.primary_key, r.default_value, r.required, r.required_reason, r.part) == ("否", "是", "'0'", "Y", "由允许空=否推导", "response")
    assert any("defaultValue" in w for w in r.warnings) and r.raw_columns["字段名"] == "hiscode" and r.interface_title == ""
    assert catalogue.segment_fields(grid(spark, rows[5:7])).count() == 0  # no marker, no segments


def test_nested_paths(spark):
    kind = "k int, a struct<b: int, c: array<struct<x: string, y: array<int>>>>, m map<string, int>, e array<array<int>>"
    rows = [(1, (5, [("p", [1, 2]), ("q", [])]), {"z": 1, "y": 2}, [[1], [], None]), (2, None, None, None), (3, (None, []), {}, [])]
    got = sorted((r.k, r.path, tuple(r.at), r.value) for r in nested.flatten_paths(spark.createDataFrame(rows, kind), ["k"]).collect() if r.value is not None)
    assert got == sorted([(1, "a.b", (), "5"), (1, "a.c[].x", (0,), "p"), (1, "a.c[].x", (1,), "q"), (1, "a.c[].y[]", (0, 0), "1"), (1, "a.c[].y[]", (0, 1), "2"), (1, "m[].key", (0,), "y"),
                          (1, "m[].value", (0,), "2"), (1, "m[].key", (1,), "z"), (1, "m[].value", (1,), "1"), (1, "e[][]", (0, 0), "1")])
    none = sorted((r.k, r.path, tuple(r.at)) for r in nested.flatten_paths(spark.createDataFrame(rows, kind), ["k"]).collect() if r.value is None)
    assert none == sorted([(1, "a.c[].y[]", (1,)), (1, "e[][]", (1,)), (1, "e[][]", (2,)), (2, "a.b", ()), (2, "a.c[]", ()), (2, "m[]", ()), (2, "e[]", ()), (3, "a.b", ()), (3, "a.c[]", ()), (3, "m[]", ()), (3, "e[]", ())])


def test_longest_root(spark):
    df = spark.createDataFrame([(1, "a/b/c"), (2, "a/bc"), (3, None), (4, "x"), (5, "a")], "id int, path string")
    roots = spark.createDataFrame([("a", "m1"), ("a/b", "m2"), ("a/b", "m0"), ("a/b/c/d", "m3"), (None, "m4")], "root string, mode string")
    out = {r.id: (r.root, r.mode) for r in keyed.longest_root(df, "path", roots, ["id"]).collect()}
    assert out == {1: ("a/b", "m0"), 2: ("a", "m1"), 3: (None, None), 4: (None, None), 5: ("a", "m1")}


def test_code_page_936(spark):
    wide = "镕".encode("gbk")
    assert encodings.encoding_of(wide) == "gb2312" and encodings.encoding_of(b"\x81") == "unknown" and encodings.encoding_of("é".encode()) == "utf8"
    files = spark.createDataFrame([("a", wide), ("b", b"plain"), ("c", None), ("d", "中".encode()), ("e", b"\xff\xfea\x00"), ("f", b"\xff")], "path string, content binary")
    assert {r.path: r.encoding for r in encodings.detect(files).collect()} == {"a": "gb2312", "b": "ascii", "c": "ascii", "d": "utf8", "e": "unknown", "f": "unknown"}
    assert encodings.recode(spark.createDataFrame([("镕".encode(),)], "content binary")).first().recoded == bytearray(wide)
    for name in ("gb2312", "GBK", "gb18030"):
        xml = f'<?xml version="1.0" encoding="{name}"?><a>镕</a>'.encode("gbk")
        assert spark.createDataFrame([(xml,)], "c binary").select(texts.xml_text(F.col("c"))).first()[0].endswith("<a>镕</a>")


def test_closure_over_known_names(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "gone"), ("gone", "c"), ("b", "d"), ("x", "b")], "name string, depends_on string")
    known = spark.createDataFrame([(n,) for n in "abcd"], "name string")
    out = graph.closure(edges, spark.createDataFrame([("a",), ("x",)], "name string"), known)
    assert sorted((r.start, r.name, r.depth) for r in out.collect()) == [("a", "a", 0), ("a", "b", 1), ("a", "d", 2)]


def test_closure_looks_back_seldom(spark, monkeypatch):
    rng = random.Random(5)
    for edges in ([(i, i + 1) for i in range(10)], [(rng.randrange(9), rng.randrange(9)) for _ in range(14)]):
        want = {}
        for start in {a for a, _ in edges}:
            front, depth = {start}, 0
            while front:
                want |= {(start, n): depth for n in front}
                front, depth = {b for a, b in edges if a in front} - {n for s, n in want if s == start}, depth + 1
        looked, df = [], graph._Seen.df
        monkeypatch.setattr(graph._Seen, "df", property(lambda self: looked.append(1) or df.fget(self)))  # noqa: B023
        names = spark.createDataFrame(sorted({(a,) for a, _ in edges}), "name int")
        out = graph.closure(spark.createDataFrame(edges, "name int, depends_on int"), names).collect()
        monkeypatch.setattr(graph._Seen, "df", df)
        assert sorted(((r.start, r.name), r.depth) for r in out) == sorted(want.items())
        assert max(want.values()) < 8 or len(looked) < max(want.values())


def test_one_root(spark):
    good = ["<a/>", " <a/>\n", '<?xml version="1.0"?><a><b>1</b><b>2</b></a>', "<!-- <x/> --><a/>", "<a/><!-- <x> -->", '<a x="1>2">t</a>', "<a><![CDATA[<b>]]></a>", "<a><a/></a>"]
    bad = ["<a/><c/>", "<a>1</a><a>2</a>", "<a>x</a> tail", "head <a/>", "<a><b></a>", "text", "", None, "<a></a><b>", "<" * 50]
    got = {r.x: r.ok for r in spark.createDataFrame([(x,) for x in good + bad], "x string").select("x", text.is_well_formed_xml(F.col("x")).alias("ok")).collect()}
    assert {x for x, ok in got.items() if ok} == set(good)


def test_attempt_rules(spark):
    runs = spark.createDataFrame([("r", "1.2"), ("old", "1.1")], "run_id string, version string")
    stages = spark.createDataFrame([("r", "explorer", "completed"), ("r", "classifier", "not-applicable"), ("r", "verifier", "completed"), ("r", "summary", "completed"), ("old", "explorer", "completed")],
                                   "run_id string, name string, status string")
    t = lambda s: T0 + dt.timedelta(seconds=s)
    attempts = spark.createDataFrame(
        [("r", "explorer", 1, "blocked", t(0), t(10), 5.0, "x"), ("r", "explorer", 2, "suspended", t(10), t(20), 10.0, "x"), ("r", "classifier", 1, "completed", t(0), t(1), 1.0, "x"),
         ("r", "summary", 1, "done", t(5), t(1), 1.0, "x"), ("r", "summary", 2, "completed", t(5), t(6), 2.0, "x"), ("r", "summary", 3, "completed", t(6), None, None, None), ("old", "explorer", 1, "odd", None, None, None, None)],
        "run_id string, stage string, attempt int, status string, started timestamp, completed timestamp, active_seconds double, reason string")
    got = sorted((r.subject, r.message) for r in manifest.attempt_rules(runs, stages, attempts).collect())
    assert got == sorted([("explorer", "stage ends with a suspended attempt"), ("classifier", "a stage that doesn't apply has attempts"), ("verifier", "stage has no attempt"), ("summary", "unknown attempt status"),
                          ("summary", "attempt times are invalid"), ("summary", "active seconds are invalid"), ("summary", "attempt is incomplete"), ("summary", "attempt times are invalid")])


@pytest.mark.parametrize("back", [False, True])
def test_attempts_alike_follow_their_place(spark, back):
    t = lambda d: T0 + dt.timedelta(days=d)
    rows = [(1, "verifier", 2, "completed", t(0), t(9), 1), (1, "verifier", 2, "suspended", t(0), t(2), 2), (1, "verifier", 3, "completed", t(5), t(6), 3),
            (2, "verifier", 2, "completed", t(0), t(2), 2), (2, "verifier", 2, "suspended", t(0), t(9), 1), (2, "verifier", 3, "completed", t(5), t(6), 3)]
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[-1], reverse=back), "run_id int, stage string, attempt int, status string, started timestamp, completed timestamp, place int").coalesce(1)
    out = intervals.attempts(df, ["run_id"], "attempt", "started", "completed", ("place",)).where("attempt = 3")
    assert out.count() == 0  # the one before ends on day 2 by place, in either order of rows
    late = df.withColumn("place", -F.col("place"))
    got = intervals.attempts(late, ["run_id"], "attempt", "started", "completed", ("place",)).where("attempt = 3").collect()
    assert sorted(map(tuple, got)) == [(n, 3, "attempt overlaps the one before") for n in (1, 2)]
    runs = spark.createDataFrame([(1, "1.2"), (2, "1.2")], "run_id int, version string")
    stages = spark.createDataFrame([(1, "verifier", "completed"), (2, "verifier", "completed")], "run_id int, name string, status string")
    attempts = df.where("attempt = 2").withColumns({"active_seconds": F.lit(1.0), "reason": F.lit("x")})
    got = manifest.attempt_rules(runs, stages, attempts, ("place",)).select("run_id", "message").collect()
    assert [tuple(r) for r in got] == [(2, "stage ends with a suspended attempt")]


def test_match_report_reads_as_markdown(spark):
    fields = spark.createDataFrame([("d|1", "v", 1, "patientId", "", "", None), ("d|1", "v", 2, "odd|Code", "n", "", None), ("e", "w", 1, "patientId", "", "", None)],
                                   "doc_id string, sheet string, row_idx int, code string, name string, json_path string, description string")
    entries = spark.createDataFrame([], "key string, candidate string, confidence double, reason string, seq int")
    out = matching.report(matching.match(fields, matching.feedback(entries), matching.rules(spark)))
    lines = {d: [r.line for r in out.where(F.col("doc_id") == d).orderBy("part", "sheet", "at", "line_no").collect()] for d in ("d|1", "e")}
    assert lines["d|1"][:5] == ["# Field Match", "", "## 字段匹配摘要", "", "- document: `d\\|1`"] and "- totalFields: `2`" in lines["d|1"]
    assert lines["d|1"][-8:] == ["", "## 需人工确认", "", "- `odd\\|Code`: 未找到可靠通用规则或项目本地反馈", "", "## 未匹配字段", "", "- `odd\\|Code` n"]
    assert lines["e"][-8:] == ["", "## 需人工确认", "", "- 暂无。", "", "## 未匹配字段", "", "- 暂无。"]


@pytest.mark.parametrize("n, size", [(0, 5), (23, 5), (25, 5), (3, 100)])
def test_pages_put_together_are_the_table(spark, n, size):
    df = spark.range(n).select((F.col("id") % 3).alias("k"), "id").repartition(4)
    out = traces.pages(df, ["k", "id"], size)
    rows = [(r.k, r.id) for r in out.orderBy("page", "place").collect()]
    assert rows == sorted((i % 3, i) for i in range(n))
    assert out.where("short").select("page").distinct().count() == (1 if n % size else 0)
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


def test_region_counts(spark):
    rows = [(1, "a\nBEGIN\nx1 x2\ny\nEND x3\nx4\nBEGIN\r\nx5"), (2, "BEGIN END\nx1"), (3, ""), (4, None)]
    out = spark.createDataFrame(rows, "k int, t string").select("k", text.region_counts(F.col("t"), {"x": "x[0-9]", "y": "y"}, "BEGIN", "END").alias("c")).collect()
    assert {r.k: r.c and tuple(r.c) for r in out} == {1: (3, 1), 2: (0, 0), 3: (0, 0), 4: None}


def test_xml_as_objects(spark):
    rows = [(1, "<Request><a1>1</a1><a1>2</a1><code>0</code></Request>"), (2, "<Request><a1>3</a1></Request>"), (3, "<R><code>x</code><s><t k='v'>w</t></s></R>"), (4, "<a><b>"), (5, None)]
    df = spark.createDataFrame(rows, "k int, x string")
    out = markup.xml_objects(df, "x")
    got = {r.k: r.object for r in out.collect()}
    assert (got[1].a1, got[1].code, got[2].a1, got[2].code, got[3].a1) == (["1", "2"], "0", ["3"], None, None)
    assert got[3].s.t._k == "v" and got[3].s.t._VALUE == "w" and got[4] is None and got[5] is None
    back = {r.k: r.x for r in out.where("object is not null").select("k", markup.objects_xml(F.col("object"), "Request").alias("x")).collect()}
    assert back[1] == rows[0][1] and back[2] == rows[1][1]


def test_key_values_at_any_depth(spark):
    rows = [(1, '{"a": [{"PrintTemp": "X"}, {"b": {"printtemp": "y", "c": "\\"PrintTemp\\": \\"no\\""}}], "PRINTTEMP": "x"}'), (2, '["PrintTemp", "z"]'), (3, '{"PrintTemp": 5, "q": {"printTemp": {"PrintTemp": "in\\u4e2d"}}}'),
            (4, "{broken"), (5, None), (6, '{"PrintTemp": " ", "q": {"Print\\u0054emp": "esc"}}'), (7, '{"a": 1, "a": 2}')]
    out = {r.k: r.v for r in spark.createDataFrame(rows, "k int, x string").select("k", text.key_values("PrintTemp")(F.col("x")).alias("v")).collect()}
    assert out == {1: ["X", "y"], 2: [], 3: ["5", "in中"], 4: None, 5: None, 6: ["esc"], 7: None}
