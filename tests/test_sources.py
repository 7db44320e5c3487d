import difflib
import random
import re
import zipfile

import pytest

from quarrystone.operators.matching import match_stems
from quarrystone.sources import delimited, office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def packed(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)


def paragraph(text, style=""):
    return f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    table = f"<w:tbl><w:tr><w:tc>{paragraph('x')}</w:tc><w:tc>{paragraph('y')}</w:tc></w:tr></w:tbl>"
    body = paragraph("One", "H1") + table + paragraph("text") + paragraph("Deep", "H2") + paragraph("more") + paragraph("Two", "H1") + paragraph("last")
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    packed(tmp_path / "in/a.docx", {"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda *t: f"<p:sld {a}><p:cSld><p:spTree>{''.join(map(shape, t))}</p:spTree></p:cSld></p:sld>"
    packed(tmp_path / "in/b.pptx", {
        "ppt/presentation.xml": f'<p:presentation {a} {R}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/>'),
        "ppt/slides/s1.xml": slide("second"), "ppt/slides/s2.xml": slide("first", " ")})
    (tmp_path / "in/bad.docx").write_bytes(b"no archive")
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    row = lambda n, *cells: f'<row r="{n}">{"".join(f"<c r={chr(34)}{c}{n}{chr(34)} t={chr(34)}inlineStr{chr(34)}><is><t>{v}</t></is></c>" for c, v in cells)}</row>'
    packed(tmp_path / "in/c.xlsx", {
        "xl/workbook.xml": f'<workbook {s} {R}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Target="worksheets/s.xml"/>'),
        "xl/sharedStrings.xml": f"<sst {s}><si><t>shared</t></si></sst>",
        "xl/worksheets/s.xml": f'<worksheet {s}><sheetData>{row(1, ("A", "a title"))}{row(3, ("A", "id"), ("C", "name"))}{row(4, ("A", "k1"), ("B", "unnamed"), ("C", " v1 "))}'
                               '<row r="5"><c r="A5" t="s"><v>0</v></c><c r="D5"><v>7</v></c></row><row r="6"/></sheetData></worksheet>'})
    return str(tmp_path / "in")


def test_office_texts_and_a_bad_file(spark, folder):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in office.read_office(spark, folder).collect()}
    assert rows["a.docx"].text == "One\ntext\nDeep\nmore\nTwo\nlast\nx\ty"
    assert rows["b.pptx"].text == "first\nsecond"
    assert rows["bad.docx"].text is None and "BadZipFile" in rows["bad.docx"].error


def test_docx_lines_and_their_outline(spark, folder):
    lines = office.read_docx_lines(spark, folder).where("error is null")
    rows = office.outline(lines).orderBy("pos").collect()
    assert [r.text for r in rows] == ["One", "x\ty", "text", "Deep", "more", "Two", "last"]
    assert [r.heading_path for r in rows] == ["One", "One", "One", "One > Deep", "One > Deep", "Two", "Two"]
    assert [r.kind for r in rows][1] == "table" and rows[0].level == 1


def test_sheet_with_a_header_further_down(spark, folder):
    rows = office.read_xlsx(spark, folder)
    assert [r.cells for r in rows.orderBy("row").collect()][0] == ["a title"]
    got = office.with_header(rows, "id").orderBy("row").collect()
    assert [r.fields for r in got] == [{"id": "k1", "name": "v1"}, {"id": "shared", "name": ""}]
    assert office.with_header(rows, "nowhere").count() == 0


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "Ch01_teach_9.csv").write_text("﻿id,to,weight\na, b ,0.5\nc,,x\n", encoding="utf-8")
    (tmp_path / "Ch02_teach_9.csv").write_text("id,to\nd,e\n", encoding="utf-8")
    got = delimited.read_edges(spark, str(tmp_path), "teach", ["id", "to"], ("weight",)).orderBy("id").collect()
    assert [(r.id, r.to, r.weight, r.view) for r in got] == [("a", "b", 0.5, "teach"), ("c", "", None, "teach"), ("d", "e", None, "teach")]
    with pytest.raises(ValueError):
        delimited.read_edges(spark, str(tmp_path), "teach", ["weight"])
    assert {r.file for r in delimited.read_csvs(spark, str(tmp_path), ["id", "weight"]).collect()} == {"Ch01_teach_9.csv"}
    (tmp_path / "Ch03_teach_10.csv").write_text("id,to\n")
    with pytest.raises(ValueError):
        delimited.read_edges(spark, str(tmp_path), "teach", ["id"])
    df = spark.createDataFrame([(1, "é\n"), (2, None)], "a long, b string")
    delimited.write_jsonl(df, str(tmp_path / "out"))
    assert sorted(delimited.read_jsonl(spark, str(tmp_path / "out"), "a long, b string").collect()) == sorted(df.collect())


def test_stems_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcd") for _ in range(4))
    stems = [" ".join(word() for _ in range(rng.randint(2, 12))) for _ in range(40)] + ["", None, "short"]
    asked = stems[:10] + [s[:-1] + "z" for s in stems[10:20]] + [s[: int(len(s) * 0.7)] for s in stems[20:30]] + ["Nothing like it at all", None]
    norm = lambda t: re.sub(r"[^a-z0-9]", "", (t or "").lower())
    grams = lambda t: {t[i : i + 4] for i in range(len(t) - 3)}
    want = {}
    for i, q in enumerate(map(norm, asked)):
        pool = [(j, s) for j, s in enumerate(map(norm, stems)) if len(s) >= 12 and len(q) >= 12 and grams(q) & grams(s)]
        pool = sorted(pool, key=lambda x: (-len(grams(q) & grams(x[1])), abs(len(x[1]) - len(q)), x[0]))[:8]
        scores = []
        for j, s in pool:
            ratio = difflib.SequenceMatcher(None, q, s, autojunk=False).ratio()
            score = 1.0 if q == s else 0.99 if (q in s or s in q) and min(len(q), len(s)) >= 0.5 * max(len(q), len(s)) else ratio
            if score >= 0.9:
                scores.append((score, -j))
        want[i] = (-max(scores)[1], round(max(scores)[0], 4)) if scores else (None, None)
    got = match_stems(spark.createDataFrame(list(enumerate(asked)), "q_id long, text string"), spark.createDataFrame(list(enumerate(stems)), "stem_id long, text string"))
    assert {r.q_id: (r.stem_id, r.similarity) for r in got.collect()} == want
