import io
import zipfile

from pyspark.sql import functions as F

from fieldloom.operators import catalogue as C
from fieldloom.operators import matching as M
from fieldloom.sources import documents as D

GRID = "doc_id string, sheet string, row_idx int, cells array<string>"


def grid(spark, *tables, context=None):
    rows = [(f"d{n}", "s", i, list(r)) for n, t in enumerate(tables) for i, r in enumerate(t)]
    df = spark.createDataFrame(rows, GRID)
    return df.withColumn("context", F.lit(context))


def got(spark, *tables, context=None):
    return C.fields(grid(spark, *tables, context=context), "context").orderBy("doc_id", "row_idx").collect()


def test_tables_without_fields(spark):
    revision = [["日期", "版本号", "修订说明", "修订人"], ["2024", "1", "x", "y"]]
    errors = [["code", "message", "description"], ["1", "bad", "x"]]
    status = [["状态码", "描述"], ["0", "ok"]]
    assert got(spark, revision, errors, status) == []
    said = C.diagnostics(C.tables(grid(spark, status)).withColumn("inherited", F.lit(False))).collect()
    assert [r.diagnostic for r in said] == ["非字段表，已跳过"]


def test_samples_are_dropped(spark):
    rows = [["参数名", "类型", "必填", "说明"], ["patientId", "String", "Y", "id"], ["请求示例", "", "", ""], ["返回示例", "", "", ""], ["返回目录", "", "", ""], ["", "", "", ""]]
    assert [f.code for f in got(spark, rows)] == ["patientId"]


def test_inherited_header(spark):
    head = [["描述", "字段名称", "是否必填", "字段说明"], ["前", "first", "Y", ""]]
    more = [["包装量", "*packageCount", "Y", "d"], ["操作员", "operator", "N", ""]]
    df = spark.createDataFrame([("d", "1", i, r) for i, r in enumerate(head)] + [("d", "2", i, r) for i, r in enumerate(more)], GRID)
    out = C.fields(df).orderBy("sheet", "row_idx").collect()
    assert [f.code for f in out] == ["first", "*packageCount", "operator"]
    assert out[1].name == "包装量" and out[1].required == "Y" and out[1].required_by_marker and not out[1].required_mismatch


def test_marker_and_path(spark):
    rows = [["字段名", "字段名称", "数据类型", "必填"], ["*mustField", "x", "String", "N"]]
    f = got(spark, rows, context="headers")[0]
    assert f.required_mismatch and f.json_path == "headers.mustField"
    assert got(spark, rows, context="prescriptions")[0].json_path == "data.prescriptions.mustField"
    assert got(spark, rows)[0].json_path == ""


def test_name_clash_and_nullable(spark):
    rows = [["参数名", "参数名称", "类型", "允许空", "描述", "默认值", "参数名"], ["a", "甲", "String", "否", "d", "'0'", "again"]]
    f = got(spark, rows)[0]
    assert (f.code, f.name, f.description) == ("a", "甲", "d") or (f.code, f.name) == ("a", "d")
    assert f.required == "Y" and f.required_reason == "由允许空=否推导"
    assert f.raw_columns["参数名#2"] == "again"
    assert "duplicateHeader:参数名" in f.warnings and any(w.startswith("defaultValue") for w in f.warnings)


def xlsx(sheets):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>shared</t></si></sst>")
        for i, rows in enumerate(sheets.values()):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + j)}{k}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v) + "</row>" for k, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet {ns}><sheetData>{body}<row><c r="B9" t="s"><v>0</v></c><c r="C9" t="s"><v>7</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_workbook(spark, tmp_path):
    head = ["字段名", "字段描述", "数据类型", "长度", "是否必填", "备注"]
    (tmp_path / "a.xlsx").write_bytes(xlsx({"Patient": [head, ["PATIENT_NAME", "n", "String", "20", "Y", ""]], "Order": [head, ["ORDER_NO", "o", "Long", "", "N", ""], ["X", "x", "", "", "", ""]]}))
    (tmp_path / "README.md").write_text("skip me")
    files = D.files(spark, str(tmp_path))
    assert [r.suffix for r in files.collect()] == [".xlsx"]
    grids = D.grids(files)
    assert grids.where("sheet = 'Patient'").orderBy("row_idx").collect()[2].cells == ["", "shared"]
    out = C.fields(grids).where("code <> ''").collect()
    assert sorted(f.code for f in out) == ["ORDER_NO", "PATIENT_NAME", "X"]
    assert [f.raw_columns["字段名"] for f in out if f.code == "PATIENT_NAME"] == ["PATIENT_NAME"]


def test_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:tbl><w:tr>{cell('a')}{cell('b  c')}</w:tr></w:tbl></w:body></w:document>")
    assert list(D.docx_rows(out.getvalue())) == [("Table 1", 0, ["a", "b c"])]


def test_matching(spark):
    fields = spark.createDataFrame([(c, "", "", "") for c in ("patientId", "orderStatus", "visitSerial", "mysteryField", "RAW_DETAIL_SECRET_FIELD")],
                                   "code string, name string, json_path string, description string")
    local = M.feedback(spark.createDataFrame([("orderStatus", "order.status", 0.96, None, 0)], "key string, candidate string, confidence double, reason string, seq int"))
    out = {r.code: r for r in M.match(fields, local, M.rules(spark)).collect()}
    assert out["patientId"].match_source == "builtin-rule" and out["patientId"].candidate == "patient.id"
    assert out["orderStatus"].candidate == "order.status" and not out["orderStatus"].needs_review
    assert out["visitSerial"].match_source == "low-confidence-candidate" and not out["visitSerial"].matched
    assert out["mysteryField"].match_source == "unmatched"
    s = M.summary(M.match(fields, local, M.rules(spark))).first()
    assert (s.total, s.matched, s.feedback, s.low_confidence, s.unmatched, s.review) == (5, 2, 1, 1, 2, 3)
