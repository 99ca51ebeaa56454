"""Document files as cell grids: ``doc_id, sheet, row_idx, cells``.

Files are read with Spark's ``binaryFile`` source and opened in tasks; XLSX and DOCX need only the
standard library. Each file must fit in a task's memory.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import text as T

GRID = "doc_id string, sheet string, row_idx int, cells array<string>"
#: Name spaces of the formats.
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def files(spark: SparkSession, path: str, recursive: bool = True, skip: tuple[str, ...] = (".gb2312.", ".gitignore", "README.md")) -> DataFrame:
    """``path, content, suffix`` of the files below ``path`` whose names hold none of ``skip``."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    for s in skip:
        df = df.where(~F.contains("path", F.lit(s)))
    return df.select("path", "content", T.extension(F.col("path")).alias("suffix"))


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]*", ref)[0]:
        n = n * 26 + ord(c) - 64
    return max(n - 1, 0)


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row from 0, cells) of a workbook; blank rows and trailing blanks are dropped."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{S}sheet"):
            target = targets.get(sheet.get(f"{R}id"), "").lstrip("/")
            part = target if target.startswith("xl/") else f"xl/{target}"
            if part not in names:
                continue
            kept = 0
            for row in ElementTree.fromstring(z.read(part)).iter(f"{S}row"):
                cells: list[str] = []
                for n, c in enumerate(row.iter(f"{S}c")):
                    at = _column(c.get("r") or "") if c.get("r") else n
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = _value(c, shared)
                while cells and not cells[-1]:
                    cells.pop()
                if cells:
                    yield sheet.get("name"), kept, cells
                    kept += 1


def _value(cell, shared: list[str]) -> str:
    kind, value = cell.get("t"), cell.find(f"{S}v")
    if kind == "inlineStr":
        raw = "".join(t.text or "" for t in cell.iter(f"{S}t"))
    else:
        raw = (value.text or "") if value is not None else ""
        if kind == "s":
            raw = shared[int(raw)] if raw.isdigit() and int(raw) < len(shared) else ""
    return " ".join(raw.split())


def docx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """(table, row from 0, cells) of every table of a document."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    for n, table in enumerate(body.iter(f"{W}tbl"), 1):
        for i, row in enumerate(table.findall(f"{W}tr")):
            yield f"Table {n}", i, [" ".join("".join(t.text or "" for t in c.iter(f"{W}t")).split()) for c in row.findall(f"{W}tc")]


def docx_paragraphs(content: bytes) -> Iterator[str]:
    """The paragraphs of a document outside its tables that hold text, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    for p in body.findall(f"{W}p") if body is not None else ():
        text = "".join(t.text or "" for t in p.iter(f"{W}t")).strip()
        if text:
            yield text


READERS = {".xlsx": xlsx_rows, ".docx": docx_rows}


def grids(docs: DataFrame) -> DataFrame:
    """Grids of ``path, content, suffix`` rows. An unknown suffix is an error; see ``supported``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content, suffix in zip(b["path"], b["content"], b["suffix"], strict=True):
                if suffix not in READERS:
                    raise ValueError(f"cannot read {suffix} files: {path}")
                yield pd.DataFrame([(path, *r) for r in READERS[suffix](bytes(content))], columns=["doc_id", "sheet", "row_idx", "cells"])

    return docs.mapInPandas(run, GRID)


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line``: the text of the DOCX files among ``path, content, suffix`` rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                yield pd.DataFrame([(path, i, p) for i, p in enumerate(docx_paragraphs(bytes(content)))], columns=["doc_id", "line_no", "line"])

    return docs.where("suffix = '.docx'").mapInPandas(run, "doc_id string, line_no int, line string")


def markdown(docs: DataFrame) -> DataFrame:
    """``doc_id, markdown`` of the DOCX files among ``path, content, suffix`` rows: the file's name as title, the paragraphs, then
    each table that has rows under its number, its first row as header. A row holds one document's text."""
    docx = docs.where("suffix = '.docx'")
    title = docx.select(F.col("path").alias("doc_id"), F.lit(0).alias("part"), F.concat(F.lit("# "), F.regexp_extract("path", "[^/]*$", 0)).alias("block"))
    said = paragraphs(docx).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("lines"))
    said = said.select("doc_id", F.lit(1).alias("part"), F.array_join("lines.line", "\n\n").alias("block"))
    number = F.regexp_extract("sheet", r"(\d+)$", 1).cast("int")
    found = grids(docx).groupBy("doc_id", number.alias("n")).agg(F.max(F.size("cells")).alias("width"), F.array_sort(F.collect_list(F.struct("row_idx", "cells"))).alias("rows"))
    body = F.transform("rows", lambda r: T.markdown_row(r["cells"], F.col("width")))
    rule = T.markdown_row(F.array_repeat(F.lit("---"), F.col("width")), 0)
    lines = F.concat(F.array(F.concat(F.lit("## 表格 "), F.col("n").cast("string")), F.lit("")), F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.size("rows")))
    blocks = title.unionByName(said).unionByName(found.select("doc_id", (F.col("n") + 1).alias("part"), F.array_join(lines, "\n").alias("block")))
    whole = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "block"))).alias("blocks"))
    return whole.select("doc_id", F.concat(F.array_join("blocks.block", "\n\n"), F.lit("\n")).alias("markdown"))


#: Folders of build output, whose modules do not count.
BUILD_FOLDERS = ("target", "archetype-resources")


def modules(spark: SparkSession, root: str) -> DataFrame:
    """``artifact, folder`` of the ``pom.xml`` files below ``root``: no build output, no ids with a placeholder, no files
    that do not parse; of several with one id the last path wins."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "pom.xml").text(root)
    df = raw.select(F.col("_metadata.file_path").alias("path"), F.from_xml("value", "artifactId string").alias("pom"))
    for folder in BUILD_FOLDERS:
        df = df.where(~F.contains("path", F.lit(f"/{folder}/")))
    df = df.select("path", F.trim("pom.artifactId").alias("artifact")).where("artifact <> ''").where(~F.contains("artifact", F.lit("$")))
    return df.groupBy("artifact").agg(F.regexp_replace(F.max("path"), "/[^/]*$", "").alias("folder"))


def supported(docs: DataFrame) -> DataFrame:
    """``suffix, files, readable`` of what is there."""
    return docs.groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), F.first(F.col("suffix").isin(*READERS)).alias("readable"))
