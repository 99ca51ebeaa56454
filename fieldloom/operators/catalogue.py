"""Field catalogues from messy document tables.

Grids are rows ``doc_id, sheet, row_idx, cells array<string>``. A table is one (doc_id, sheet).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text as T

#: Spellings of the headers of each role.
HEADERS = {
    "code": ("参数名", "参数名称", "参数代码", "参数", "字段", "字段名", "字段名称", "字段代码", "字段编码", "数据项代码", "数据字段名", "数据元英文名称", "代码", "field", "field name", "code", "parameter", "param"),
    "name": ("描述", "中文名", "参数名称", "数据项名称", "字段描述", "数据元中文名称", "名称", "name"),
    "field_type": ("数据类型", "数据项类型", "参数类型", "类型", "字段类型", "type", "datatype", "data type"),
    "length": ("长度", "数据长度", "字段长度", "length", "len"),
    "required": ("是否必填", "必填", "是否必须", "非空", "required", "mandatory", "not null"),
    "nullable": ("允许空", "可空", "是否允许空", "nullable", "allow null"),
    "primary_key": ("主键", "是否主键", "primary key", "pk"),
    "default_value": ("默认值", "缺省值", "default", "default value"),
    "description": ("备注", "说明", "字段说明", "描述", "description", "remark", "remarks"),
}
SECOND_NAMES = (("描述",), ("中文名", "名称", "字段描述"))
#: Headers of tables that list no fields.
SKIP_SUPERSETS = (("日期", "版本号", "修订说明"), ("code", "message"), ("状态码", "描述"), ("错误码", "描述"))
SKIP_EQUAL = (("编码", "描述"), ("代码", "名称"))
TABLE = ["doc_id", "sheet"]


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _find(headers: Column, choices, without: list[Column] = ()) -> Column:
    """Position from 1 of the first header among ``choices``, other than ``without``; 0 if none."""
    def ok(h: Column, i: Column) -> Column:
        keep = F.array_contains(_lits(choices), h)
        for w in without:
            keep = keep & (i + 1 != w)
        return F.when(keep, i + 1)

    return F.coalesce(F.array_min(F.filter(F.transform(headers, ok), lambda x: x.isNotNull())), F.lit(0))


def _any(headers: Column, *roles: str) -> Column:
    return F.arrays_overlap(headers, _lits(sorted({v for r in roles for v in HEADERS[r]})))


def normal(cells: Column) -> Column:
    return F.transform(cells, T.header)


def tables(grids: DataFrame) -> DataFrame:
    """One row per table: ``first`` row, ``header_idx`` and ``headers`` of the first header row (null
    if none), whether it is ``skipped`` and whether its rows ``look_like_fields``."""
    n = normal(F.col("cells"))
    is_header = _any(n, "code", "name") & _any(n, "field_type", "description")
    code, required = T.text(F.try_element_at("cells", F.lit(2))), F.upper(T.text(F.try_element_at("cells", F.lit(3))))
    fieldish = (F.size("cells") >= 2) & code.rlike(r"^\*?[A-Za-z_][A-Za-z0-9_]*$") & required.isin("Y", "N", "是", "否", "")
    filled = F.exists("cells", lambda c: T.text(c) != "")
    marked = grids.withColumn("_h", is_header).withColumn("_f", F.when(filled, F.struct("row_idx", fieldish.alias("ok"))))
    out = marked.groupBy(*TABLE).agg(
        F.min_by("cells", "row_idx").alias("first"), F.min(F.when(F.col("_h"), F.col("row_idx"))).alias("header_idx"),
        F.min_by("cells", F.when(F.col("_h"), F.col("row_idx"))).alias("headers"),
        F.min(F.when(F.col("_f.ok"), F.col("row_idx"))).alias("_first_field"), F.min(F.when(F.col("_f").isNotNull(), F.col("row_idx"))).alias("_first_filled"))
    head = F.array_distinct(F.filter(normal(F.col("first")), lambda h: h != ""))
    skipped = F.lit(False)
    for s in SKIP_SUPERSETS:
        skipped = skipped | (F.size(F.array_except(_lits(s), head)) == 0)
    for s in SKIP_EQUAL:
        skipped = skipped | ((F.size(F.array_except(_lits(s), head)) == 0) & (F.size(head) == len(s)))
    look = F.coalesce(F.col("_first_field") - F.col("_first_filled") < 8, F.lit(False))
    return out.select(*TABLE, "first", "header_idx", F.when(F.col("header_idx").isNotNull(), F.col("headers")).alias("headers"),
                      skipped.alias("skipped"), look.alias("look_like_fields"))


def with_inherited(by_table: DataFrame, order: str = "sheet") -> DataFrame:
    """Tables without a header take the latest header seen before them in their document, if
    their rows look like fields."""
    seen = F.last(F.when(~F.col("skipped"), F.col("headers")), ignorenulls=True).over(
        Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    take = F.col("headers").isNull() & F.col("look_like_fields") & ~F.col("skipped")
    out = by_table.withColumn("_seen", seen)
    return out.withColumn("inherited", take & F.col("_seen").isNotNull()).withColumn(
        "headers", F.when(F.col("inherited"), F.col("_seen")).otherwise(F.col("headers"))).drop("_seen")


def roles(by_table: DataFrame) -> DataFrame:
    """Adds ``role_*``: positions from 1 (0: absent) of each role's column, with the clashes of
    name and description settled."""
    df = by_table.withColumn("_n", normal(F.col("headers")))
    df = df.withColumns({f"_{r}": _find(F.col("_n"), HEADERS[r]) for r in HEADERS})
    other = F.lit(0)
    for choices in reversed(SECOND_NAMES):
        at = _find(F.col("_n"), choices)
        other = F.when((at > 0) & (at != F.col("_code")), at).otherwise(other)
    df = df.withColumn("_name", F.when((F.col("_code") > 0) & (F.col("_name") == F.col("_code")), other).otherwise(F.col("_name")))
    clash = (F.col("_description") > 0) & ((F.col("_description") == F.col("_code")) | (F.col("_description") == F.col("_name")))
    df = df.withColumn("_description", F.when(clash, _find(F.col("_n"), HEADERS["description"], [F.col("_code"), F.col("_name")])).otherwise(F.col("_description")))
    return df.select(*by_table.columns, *[F.col(f"_{r}").alias(f"role_{r}") for r in HEADERS])


def diagnostics(by_table: DataFrame) -> DataFrame:
    """``doc_id, sheet, diagnostic`` of tables that give no fields."""
    said = F.when(F.col("skipped"), "非字段表，已跳过").when(F.col("headers").isNull(), "未识别字段表头")
    return by_table.select(*TABLE, said.alias("diagnostic")).where("diagnostic is not null")


def header_keys(headers: Column) -> Column:
    """A key for each header; blank ones are ``columnN``, repeated ones get ``#2``, ``#3``, ..."""
    named = F.transform(headers, lambda h, i: F.when(T.text(h) == "", F.concat(F.lit("column"), (i + 1).cast("string"))).otherwise(T.text(h)))
    return F.transform(named, lambda h, i: F.concat(h, F.when(
        F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == h)) > 1,
        F.concat(F.lit("#"), F.size(F.filter(F.slice(named, F.lit(1), i + 1), lambda x: x == h)).cast("string"))).otherwise("")))


def header_map(keys: Column, cells: Column) -> Column:
    """Cells by the keys of their headers."""
    return F.map_from_arrays(keys, F.transform(keys, lambda k, i: T.text(F.try_element_at(cells, i + 1))))


def header_warnings(headers: Column, roles_at: list[Column]) -> Column:
    """Repeated headers and headers without a role."""
    n = normal(headers)
    repeated = F.transform(F.filter(F.transform(headers, lambda h, i: F.struct(T.text(h).alias("h"), i.alias("i"), F.array_position(n, T.header(h)).alias("p"))),
                                    lambda s: (s["h"] != "") & (s["p"] < s["i"] + 1)), lambda s: F.concat(F.lit("duplicateHeader:"), s["h"]))
    used = F.transform(F.filter(F.array(*roles_at), lambda r: r > 0), lambda r: T.text(F.try_element_at(headers, r.cast("int"))))
    left = F.transform(F.filter(F.transform(headers, T.text), lambda h: (h != "") & ~F.array_contains(used, h)), lambda h: F.concat(F.lit("unmappedHeader:"), h))
    return F.concat(repeated, left)


def fields(grids: DataFrame, context: str | None = None, inherit: bool = True) -> DataFrame:
    """The fields of all tables, one row each.

    ``context`` names a column of ``grids`` with the part of the message a row belongs to, for
    ``json_path``. Rows without code and name, sample rows and blank rows are left out. With ``inherit``, tables without
    a header take one from the tables before.
    """
    by_table = tables(grids)
    by_table = with_inherited(by_table) if inherit else by_table.withColumn("inherited", F.lit(False))
    known = roles(by_table.where("not skipped and headers is not null")).drop("first")
    # What depends on the header alone is worked out once per table.
    known = known.withColumn("_keys", header_keys(F.col("headers"))).withColumn("_warned", header_warnings(F.col("headers"), [F.col(f"role_{r}") for r in HEADERS]))
    rows = grids.join(known, TABLE).where(F.col("inherited") | (F.col("row_idx") > F.col("header_idx")))
    get = {r: T.text(F.when(F.col(f"role_{r}") > 0, F.try_element_at("cells", F.col(f"role_{r}").cast("int")))) for r in HEADERS}
    rows = rows.withColumns({f"_{r}": c for r, c in get.items()})
    rows = rows.where(~T.is_sample(F.col("_code")) & ((F.col("_code") != "") | (F.col("_name") != "")))
    inferred = T.required_from_nullable(F.col("_nullable"))
    required = F.when(F.col("_required") != "", F.col("_required")).otherwise(inferred)
    head = lambda r: F.coalesce(F.try_element_at("headers", F.nullif(F.col(f"role_{r}").cast("int"), F.lit(0))), F.lit(""))
    reason = (F.when(F.col("_required") != "", F.concat(F.lit("由"), head("required"), F.lit("="), F.col("_required"), F.lit("提供")))
              .when(inferred != "", F.concat(F.lit("由"), head("nullable"), F.lit("="), F.col("_nullable"), F.lit("推导"))).otherwise(""))
    path = T.json_path(F.col("_code"), F.col(context)) if context else F.lit("")
    return rows.select(
        *TABLE, "row_idx", *[F.col(f"_{r}").alias(r) for r in HEADERS if r != "required"], required.alias("required"),
        reason.alias("required_reason"), F.col("_code").startswith("*").alias("required_by_marker"),
        T.marker_mismatch(F.col("_code"), required).alias("required_mismatch"), path.alias("json_path"),
        header_map(F.col("_keys"), F.col("cells")).alias("raw_columns"),
        F.concat("_warned", F.when(F.col("_default_value") != "", F.array(F.lit("defaultValue:需要人工确认默认值语义"))).otherwise(F.array().cast("array<string>"))).alias("warnings"),
        F.lit("mapped-field").alias("classification"), F.lit(1.0).alias("confidence"))


def summary(catalogue: DataFrame) -> DataFrame:
    """Per document: views, fields, warnings, inferred required flags."""
    return catalogue.groupBy("doc_id").agg(F.countDistinct("sheet").alias("views"), F.count(F.lit(1)).alias("fields"), F.sum(F.size("warnings")).alias("warnings"),
                                           F.count_if(F.col("required_reason").endswith("推导")).alias("inferred_required"))


def diagnostics_report(catalogue: DataFrame, notes: DataFrame, converter: str = "built-in") -> DataFrame:
    """``doc_id, line_no, line``: the diagnostics of each document that has fields or notes: counts of views, fields, warnings, fields of low
    confidence and inferred required flags, then its notes (``doc_id, sheet, diagnostic``), each once, by table."""
    counts = catalogue.groupBy("doc_id").agg(
        F.countDistinct("sheet").alias("views"), F.count(F.lit(1)).alias("fields"), F.sum(F.size("warnings")).alias("warned"),
        F.count_if(F.col("confidence") < 1).alias("low"), F.count_if(F.col("required_reason").contains("推导")).alias("inferred"))
    said = notes.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("sheet", "diagnostic"))).alias("notes"))  # a line a table at most
    both = counts.join(said, "doc_id", "full")
    told = [F.concat(F.lit(f"- {label}: `"), F.coalesce(F.col(c), F.lit(0)).cast("string"), F.lit("`")) for label, c in (
        ("views", "views"), ("fields", "fields"), ("fieldWarnings", "warned"), ("lowConfidenceFields", "low"), ("inferredRequiredFields", "inferred"))]
    head = F.array(F.lit("# Diagnostics"), F.lit(""), F.lit(f"- converter: `{converter}`"), *told, F.lit(""), F.lit("## Notes"), F.lit(""))
    none = F.array(F.lit("- 未发现解析级错误；字段语义匹配仍需后续诊断。"))
    listed = F.coalesce(F.transform("notes", lambda n: F.concat(F.lit("- "), n["diagnostic"])), none)
    return both.select("doc_id", F.posexplode(F.concat(head, listed)).alias("line_no", "line"))


def review(documents: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``doc_id, issue`` for documents without fields and fields without code and name."""
    empty = documents.select("doc_id").join(catalogue.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("no fields").alias("issue"))
    return empty.union(catalogue.where("code = '' and name = ''").select("doc_id", F.lit("field without code and name").alias("issue")))


#: What marks the rows and lines of the parts of an interface, by part.
TITLE_LABELS, NOTE_LABELS = ("名称", "name"), ("功能描述", "description")
ROW_MARKS = (("interface", ("接口名称",)), ("request", ("请求参数", "请求参数加密前", "入参", "入参格式说明")), ("response", ("返回结果", "响应参数", "响应消息说明", "出参")))
LINE_MARKS = (("signature", ("签名算法", "参与签名字段")), ("headers", ("请求头公共参数", "公共请求头", "header参数")), ("request", ("入参格式说明", "入参", "请求参数")),
              ("response", ("响应消息说明", "响应参数", "返回参数", "出参")), ("data", ("data参数属性描述如下",)))
INTERFACE, PLAIN_TITLE = "接口", "接口说明"


def interface_titles(grids: DataFrame, rows: int = 6) -> DataFrame:
    """``doc_id, sheet, title``: name and description given in the first ``rows`` rows of a table, as
    ``name（description）``; tables without a name have none."""
    label, value = T.header(F.try_element_at("cells", F.lit(1))), T.text(F.try_element_at("cells", F.lit(2)))
    said = (F.size("cells") >= 2) & (value != "") & (value != T.text(F.try_element_at("cells", F.lit(1))))
    at = F.row_number().over(Window.partitionBy(*TABLE).orderBy("row_idx"))
    top = grids.select(*TABLE, "row_idx", "cells", at.alias("_at")).where(F.col("_at") <= rows)
    g = top.groupBy(*TABLE).agg(*[F.min_by(value, F.when(said & label.isin(*names), F.col("row_idx"))).alias(n) for n, names in (("_t", TITLE_LABELS), ("_d", NOTE_LABELS))],
                                *[F.max(F.when(said & label.isin(*names), 1)).alias(n) for n, names in (("_ht", TITLE_LABELS), ("_hd", NOTE_LABELS))])
    title = F.when(F.col("_ht").isNotNull(), F.when(F.col("_hd").isNotNull(), F.concat("_t", F.lit("（"), F.col("_d"), F.lit("）"))).otherwise(F.col("_t")))
    return g.select(*TABLE, title.alias("title")).where("title is not null")


def _marked(text: Column, marks) -> Column:
    out = F.lit(None).cast("string")
    for part, words in reversed(marks):
        out = F.when(F.greatest(*[F.instr(text, w) for w in words], F.lit(0)) > 0, part).otherwise(out)
    return out


def row_marker(cells: Column) -> Column:
    """interface, request or response for a row that begins such a part, else null."""
    return _marked(T.row_text(cells), ROW_MARKS)


def interface_hints(catalogue: DataFrame) -> DataFrame:
    """``doc_id, sheet, hint``: the capitals that the first field ``n_type`` of a table with any names."""
    text = F.replace(F.concat_ws(" ", "name", "description"), F.lit(" "), F.lit(""))
    found = F.regexp_extract(text, "[A-Z][A-Z0-9_]{3,}", 0)
    named = catalogue.where((F.lower(T.field_code(F.col("code"))) == "n_type") & (found != ""))
    return named.groupBy(*TABLE).agg(F.min_by(found, "row_idx").alias("hint"))


def section_context(by_line: DataFrame, key: str = "doc_id", order: str = "line_no", line: str = "line") -> DataFrame:
    """``key, order, line`` (cleaned) and what holds from each line on: ``interface_no, interface_title, subsection_no,
    subsection_title, part``.

    A heading ``3.n title`` of an interface, or ``3.n`` alone with the title in one of the three lines before,
    starts an interface and ends the subsection; ``3.n.m title`` starts a subsection. ``part`` is the
    part of the message that the lines after belong to. Blank lines and lines of a table of contents say
    nothing. Each thing that holds is the last one said before, by a window over the lines of a document.
    """
    raw = F.coalesce(F.col(line), F.lit(""))
    df = by_line.select(key, order, T.section_line(F.col(line)).alias("line"), T.is_contents_line(raw).alias("_toc")).where("line <> ''")
    l = F.col("line")
    w = Window.partitionBy(key).orderBy(order)
    df = df.withColumn("_near", F.collect_list("line").over(w.rowsBetween(-3, -1)))
    fits = F.filter(F.reverse("_near"), lambda x: x.endswith(INTERFACE) & ~x.rlike("^[0-9]") & (x != PLAIN_TITLE))
    near = F.try_element_at(fits, F.lit(1))
    live = ~F.col("_toc")
    direct = live & l.rlike(rf"^3\.[0-9]+\s+.+{INTERFACE}$")
    alone = live & l.rlike(r"^3\.[0-9]+$")
    opened = direct | (alone & near.isNotNull())
    inner = live & l.rlike(r"^3\.[0-9]+\.[0-9]+\s*\S")
    deep = lambda g: F.regexp_extract(l, r"^(3\.[0-9]+\.[0-9]+)\s*(.+?)$", g)
    begin = F.when(opened, F.struct(
        F.regexp_extract(l, r"^(3\.[0-9]+)", 1).alias("no"), F.when(direct, F.regexp_extract(l, r"^3\.[0-9]+\s+(.+)$", 1)).otherwise(near).alias("title")))
    # A new interface resets the subsection to blanks.
    sub = F.when(opened, F.struct(F.lit("").alias("no"), F.lit("").alias("title"))).when(inner, F.struct(deep(1).alias("no"), deep(2).alias("title")))
    named = F.nullif(F.regexp_extract(l, r"^([A-Za-z_][A-Za-z0-9_]*)\s*参数$", 1), F.lit(""))
    said = F.coalesce(named, _marked(F.replace(F.lower(l), F.lit(" "), F.lit("")), LINE_MARKS), F.when(inner & deep(2).contains("返回"), "response"))
    part = F.when(live & ~opened & ~alone, said)
    df = df.withColumns({"_begin": begin, "_sub": sub, "_part": part})
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    held = {c: F.last(c, ignorenulls=True).over(upto) for c in ("_begin", "_sub", "_part")}
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(key, order, "line", blank(held["_begin"]["no"]).alias("interface_no"), blank(held["_begin"]["title"]).alias("interface_title"),
                     blank(held["_sub"]["no"]).alias("subsection_no"), blank(held["_sub"]["title"]).alias("subsection_title"), blank(held["_part"]).alias("part"))


def segments(grids: DataFrame, context: str | None = None) -> DataFrame:
    """Tables cut at their marker rows: ``grids``' rows with ``segment`` (the number of markers so far) and ``part``.

    A row that names the request or the response starts a segment of that part; what else stands in it, but for its first
    marker cell, is the segment's first row. A row that names an interface ends a segment and goes. The part holds until the
    next one is named; before the first it is ``context`` (a column of ``grids``, if any). Blank rows go, and so do tables
    without a marker: they are no segments.
    """
    rows = Window.partitionBy(*TABLE).orderBy("row_idx")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    marker = row_marker(F.col("cells"))
    named = F.when(marker.isin("request", "response"), marker)
    at = F.get(F.filter(F.transform("cells", lambda c, i: F.when(row_marker(F.array(c)).isNotNull(), i)), lambda i: i.isNotNull()), F.lit(0))
    df = grids.withColumns({"_marker": marker, "_named": named, "_at": F.when(named.isNotNull(), at)})
    df = df.withColumns({"segment": F.count("_marker").over(upto), "part": F.coalesce(F.last("_named", ignorenulls=True).over(upto), F.col(context) if context else F.lit("")),
                         "_markers": F.count("_marker").over(Window.partitionBy(*TABLE))})
    bare = F.transform("cells", lambda c, i: F.when(i == F.col("_at"), "").otherwise(c))
    df = df.where("_markers > 0 and (_marker is null or _marker <> 'interface')").withColumn("cells", F.when(F.col("_at").isNull(), F.col("cells")).otherwise(bare))
    return df.where(F.exists("cells", lambda c: T.text(c) != "")).drop("_marker", "_named", "_at", "_markers")


def segment_fields(grids: DataFrame, context: str | None = None) -> DataFrame:
    """The fields of segmented tables, with ``segment``, ``part`` and ``interface_title`` beside what ``fields`` gives.

    Every segment has a header of its own, the marker row's rest or a row below it; none is inherited. A segment's title
    is the interface that its own fields name (see ``interface_hints``), else the last one named by a segment before it in its
    table; '' without one.
    """
    cut = segments(grids, context)
    as_tables = cut.withColumn("sheet", F.struct("sheet", "segment"))
    found = fields(as_tables, "part", inherit=False)
    hints = interface_hints(found)
    titled = found.select(*TABLE).distinct().join(hints, TABLE, "left")
    before = Window.partitionBy("doc_id", "sheet.sheet").orderBy("sheet.segment").rowsBetween(Window.unboundedPreceding, 0)
    titled = titled.select(*TABLE, F.coalesce(F.last("hint", ignorenulls=True).over(before), F.lit("")).alias("interface_title"))
    parts = cut.select("doc_id", F.struct("sheet", "segment").alias("sheet"), "part").distinct()
    out = found.join(titled, TABLE).join(parts, TABLE)
    return out.select("doc_id", "sheet.sheet", "sheet.segment", *[c for c in out.columns if c not in TABLE])


def field_report(catalogue: DataFrame) -> DataFrame:
    """``doc_id, sheet, row_idx, line``: the fields as rows of a Markdown table of twelve columns; the marker is ``*``
    for a field marked as required, with `` mismatch`` where its column says otherwise."""
    marker = F.concat(F.when(F.col("required_by_marker"), "*").otherwise(""), F.when(F.col("required_mismatch"), " mismatch").otherwise(""))
    cells = F.array("json_path", "code", "name", "field_type", "length", "required", "nullable", "primary_key", "default_value", marker, "description", F.array_join("warnings", "; "))
    return catalogue.select(*TABLE, "row_idx", T.markdown_row(cells, 12).alias("line"))


def parsed_envelope(catalogue: DataFrame) -> DataFrame:
    """``doc_id, json``: the document with its views and their fields as one JSON object. A document's
    fields are few; nothing of other documents is put together with them."""
    fields = [c for c in catalogue.columns if c not in TABLE]
    by = lambda name: lambda a, b: F.when(a[name] < b[name], -1).when(a[name] > b[name], 1).otherwise(0)
    views = catalogue.groupBy(*TABLE).agg(F.array_sort(F.collect_list(F.struct(*fields)), by("row_idx")).alias("fields"))
    docs = views.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sheet", "fields")), by("sheet")).alias("views"))
    return docs.select("doc_id", F.to_json(F.struct("doc_id", F.size("views").alias("view_count"), "views")).alias("json"))


def sections(rows: DataFrame, marker: Column, order: str = "row_idx") -> DataFrame:
    """Adds ``segment``: how many marker rows there are up to each row of its table."""
    return rows.withColumn("segment", F.sum(marker.cast("int")).over(Window.partitionBy(*TABLE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
