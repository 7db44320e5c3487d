"""Office files as tables: DOCX and PPTX texts, DOCX lines with their styles, XLSX rows. A file is a row of ``binaryFile`` and
is parsed by its task from the ZIP and XML alone; one that can't be read keeps a row with its error."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _paragraph(p: ElementTree.Element) -> str:
    marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
    return "".join((e.text or "") if e.tag == f"{W}t" else marks.get(e.tag, "") for r in p.iter(f"{W}r") for e in r)


def _table(t: ElementTree.Element) -> list[str]:
    cells = lambda row: ("\n".join(_paragraph(p) for p in c.findall(f"{W}p")) for c in row.findall(f"{W}tc"))
    return ["\t".join(cells(row)) for row in t.findall(f"{W}tr")]


def _body(z: zipfile.ZipFile) -> ElementTree.Element:
    return ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")


def docx_text(z: zipfile.ZipFile) -> str:
    """Paragraphs, then the rows of all tables with their cells joined by tabs."""
    body = _body(z)
    return "\n".join([_paragraph(p) for p in body.findall(f"{W}p")] + [row for t in body.findall(f"{W}tbl") for row in _table(t)])


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = ElementTree.fromstring(z.read(f"{folder}/_rels/{name}.rels"))
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in root}


def pptx_text(z: zipfile.ZipFile) -> str:
    """Text frames that aren't blank, in the order of slides and shapes."""
    part = "ppt/presentation.xml"
    to, out = _targets(z, part), []
    for slide in ElementTree.fromstring(z.read(part)).iter(f"{P}sldId"):
        tree = ElementTree.fromstring(z.read(to[slide.get(f"{R}id")])).find(f"{P}cSld/{P}spTree")
        for body in tree.findall(f"{P}sp/{P}txBody"):
            frame = "\n".join("".join((e.text or "") if e.tag == f"{A}t" else "\v" if e.tag == f"{A}br" else "" for e in p.iter()) for p in body.findall(f"{A}p"))
            if frame.strip():
                out.append(frame)
    return "\n".join(out)


def docx_lines(z: zipfile.ZipFile) -> list[tuple]:
    """(kind, style, level, text) of the body in its order; a table's rows are lines of their own."""
    names = {}
    if "word/styles.xml" in z.namelist():
        for s in ElementTree.fromstring(z.read("word/styles.xml")).findall(f"{W}style"):
            name = s.find(f"{W}name")
            names[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else None
    out = []
    for e in _body(z):
        if e.tag == f"{W}tbl":
            out += [("table", None, None, row) for row in _table(e)]
        elif e.tag == f"{W}p":
            s = e.find(f"{W}pPr/{W}pStyle")
            style = names.get(s.get(f"{W}val"), s.get(f"{W}val")) if s is not None else None
            level = re.fullmatch(r"[Hh]eading ?(\d)", style or "")
            out.append(("paragraph", style, int(level[1]) if level else None, _paragraph(e)))
    return out


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def xlsx_rows(z: zipfile.ZipFile) -> list[tuple]:
    """(sheet, row, cells): cells as text, trimmed, null where empty; rows count from 1."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
    part, out = "xl/workbook.xml", []
    to = _targets(z, part)
    for sheet in ElementTree.fromstring(z.read(part)).iter(f"{S}sheet"):
        for i, row in enumerate(ElementTree.fromstring(z.read(to[sheet.get(f"{R}id")])).iter(f"{S}row"), 1):
            cells: list[str | None] = []
            for c in row.findall(f"{S}c"):
                at = _column(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (at + 1 - len(cells))
                value = c.findtext(f"{S}v")
                if c.get("t") == "s":
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{S}t"))
                cells[at] = (value or "").strip() or None
            out.append((sheet.get("name"), int(row.get("r", i)), cells))
    return out


def _files(spark: SparkSession, folder: str, kinds: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{kinds}}}").load(folder).select("path", "content")


def _parsed(spark: SparkSession, folder: str, parsers: dict[str, Callable], schema: str, rows: Callable) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.sub(r"<[^>]*>", "", schema).split(", ")]
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        out += [(path, *r, None) for r in rows(parsers[path.rsplit(".", 1)[-1].lower()](z))]
                except Exception as e:  # noqa: BLE001 - a bad file is a row with its error
                    out.append((path, *[None] * (len(columns) - 2), f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    return _files(spark, folder, ",".join(parsers)).mapInPandas(run, schema)


def read_office(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text, error) of all DOCX and PPTX files below ``folder``; either text or error is null."""
    return _parsed(spark, folder, {"docx": docx_text, "pptx": pptx_text}, "path string, text string, error string", lambda text: [(text,)])


def read_docx_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, pos, kind, style, level, text, error): paragraphs and table rows of DOCX files in their order."""
    schema = "path string, pos long, kind string, style string, level long, text string, error string"
    return _parsed(spark, folder, {"docx": docx_lines}, schema, lambda lines: [(i, *x) for i, x in enumerate(lines)])


def read_xlsx(spark: SparkSession, folder: str) -> DataFrame:
    """(path, sheet, row, cells, error) of all XLSX files below ``folder``."""
    return _parsed(spark, folder, {"xlsx": xlsx_rows}, "path string, sheet string, row long, cells array<string>, error string", lambda rows: rows)


def with_header(rows: DataFrame, sentinel: str) -> DataFrame:
    """(path, sheet, row, fields): rows below the first one that has the cell ``sentinel``, as maps from that row's names.
    Sheets without it give none; empty rows and unnamed columns are left out, and of equal names the last counts."""
    rows = rows.where("error is null")
    heads = rows.where(F.array_contains("cells", sentinel)).groupBy("path", "sheet").agg(F.min_by("cells", "row").alias("names"), F.min("row").alias("head"))
    named = lambda z: z["names"].isNotNull()
    fields = F.filter(F.arrays_zip("names", F.slice("cells", F.lit(1), F.least(F.size("cells"), F.size("names"))).alias("cells")), named)
    entries = F.transform(fields, lambda z: F.struct(z["names"], F.coalesce(z["cells"], F.lit(""))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["names"] == e["names"]))
    body = rows.join(heads, ["path", "sheet"]).where((F.col("row") > F.col("head")) & F.exists("cells", lambda c: c.isNotNull()))
    return body.select("path", "sheet", "row", F.map_from_entries(last).alias("fields"))


def outline(lines: DataFrame, levels: int = 3) -> DataFrame:
    """``lines`` with ``heading_path``: for each line the headings above it, joined by `` > ``; a heading ends deeper ones.
    Files are windows of their own, so no task holds more than one file's lines."""
    upto = Window.partitionBy("path").orderBy("pos")
    last = [F.max(F.when(F.col("level") == k, F.struct("pos", "text"))).over(upto) for k in range(1, levels + 1)]
    out = lines.withColumns({f"h{k}_": c for k, c in enumerate(last, 1)})
    parts = [F.col("h1_.text")]
    for k in range(2, levels + 1):
        above = F.greatest(*[F.coalesce(F.col(f"h{j}_.pos"), F.lit(-1)) for j in range(1, k)], F.lit(-1))
        parts.append(F.when(F.col(f"h{k}_.pos") > above, F.col(f"h{k}_.text")))
    return out.withColumn("heading_path", F.concat_ws(" > ", *parts)).drop(*[f"h{k}_" for k in range(1, levels + 1)])
