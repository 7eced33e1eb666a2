"""Encodings by file, workbooks, source layouts, numbering by ranges."""

import random
import zipfile

import pytest
from pyspark.sql import functions as F

from skillweave.operators import numbering
from skillweave.sources import delimited, records, tables, workbooks

ROWS = [["name", "n", "when", "at", "ok", "note"], ["Zoë", 1, "2024-02-29", "2024-02-29 13:30:00", "true", "a, \"b\"\nc"], ["Kỹ sư", 2.5, None, None, "false", None], ["José", -3, "1999-12-31", None, None, " padded "]]


def as_csv(rows):
    cell = lambda c: "" if c is None else '"' + str(c).replace('"', '""') + '"'
    return "\n".join(",".join(map(cell, r)) for r in rows) + "\n"


def workbook(path, rows, extra="", odd=False):
    """A workbook of two sheets; strings shared, in runs or inline, dates as serial numbers with a style."""
    from datetime import datetime
    from xml.sax.saxutils import escape

    shared = []

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r}"
        if v is None:
            return f'<c r="{ref}"/>' if odd else ""
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v in ("true", "false"):
            return f'<c r="{ref}" t="b"><v>{int(v == "true")}</v></c>'
        if r > 1 and v[:4].isdigit() and "-" in v:
            at = datetime.fromisoformat(v) - datetime(1899, 12, 30)
            return f'<c r="{ref}" s="{1 if len(v) == 10 else 2}"><v>{at.days + at.seconds / 86400}</v></c>'
        if c == 5 and r > 1:
            return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>'
        shared.append(f"<si><r><t>{escape(v[:1])}</t></r><r><t>{escape(v[1:])}</t></r><rPh><t>no</t></rPh></si>" if odd else f"<si><t>{escape(v)}</t></si>")
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    body = "".join(f'<row r="{i}">' + "".join(cell(i, c, v) for c, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f"<worksheet {main}><sheetData>{{}}</sheetData></worksheet>"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="urn:r"><sheets><sheet name="Jobs" sheetId="1" r:id="x1"/><sheet name="More" sheetId="2" r:id="x2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x1" Target="worksheets/a.xml"/><Relationship Id="x2" Target="/xl/worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", sheet.format(body + extra))
        z.writestr("xl/worksheets/b.xml", sheet.format('<row><c t="str"><v>k</v></c><c><v>1</v></c></row><row/><row><c t="e"><v>#N/A</v></c><c><v>2</v></c></row>'))
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{''.join(shared)}</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="[$-409]yyyy\\-mm\\-dd&quot; at &quot;hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')


@pytest.mark.parametrize("odd", [False, True])
def test_workbook_equals_its_csv(spark, tmp_path, odd):
    workbook(tmp_path / "a.xlsx", ROWS, odd=odd)
    (tmp_path / "a.csv").write_text(as_csv(ROWS))
    got, want = workbooks.read_workbook(spark, str(tmp_path / "a.xlsx")), tables.read_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    typed = workbooks.read_workbook(spark, str(tmp_path / "a.xlsx"), "n double, `when` date, at timestamp, ok boolean, gone string")
    assert [str(r.when) for r in typed.orderBy("n").collect()] == ["1999-12-31", "2024-02-29", "None"]
    assert typed.agg(F.sum("n"), F.count("at"), F.count("ok"), F.count("gone")).first()[:] == (0.5, 1, 2, 0)


def test_sheets_and_several_workbooks(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", ROWS)
    workbook(tmp_path / "b.xlsx", [["n", "extra", "n", None, "x"], [9, "e", 8, 7, None]])
    both = workbooks.read_workbook(spark, str(tmp_path))
    assert both.columns == [*ROWS[0], "extra", "n.1", "Unnamed: 3", "x"] and both.count() == 4
    assert both.filter("n = '9'").select("name", "extra", "`n.1`", "Unnamed: 3", "x").first()[:] == (None, "e", "8", "7", None)
    more = workbooks.read_workbook(spark, str(tmp_path / "a.xlsx"), sheet="More")
    assert more.columns == ["k", "1"] and [tuple(r) for r in more.collect()] == [(None, "2")]
    assert workbooks.read_workbook(spark, str(tmp_path), "k string", "None such").count() == 0


def test_encodings_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('name,tëxt\nJosé,"a ""b""\nc 世界"\nx,\n'.encode())
    (tmp_path / "b.csv").write_bytes('name,tëxt\nJosé,"café\nü"\n\ny,z\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("﻿name,tëxt\nKỹ sư,€ and �\n".encode())
    got = delimited.read_delimited(spark, str(tmp_path))
    assert got.columns == ["name", "tëxt"]
    assert sorted((r[0], r[1] or "") for r in got.collect()) == [("José", 'a "b"\nc 世界'), ("José", "café\nü"), ("Kỹ sư", "€ and �"), ("x", ""), ("y", "z")]
    marked = delimited.read_delimited(spark, str(tmp_path / "c.csv"))
    assert marked.columns == ["name", "tëxt"] and marked.first().name == "Kỹ sư"
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "d.csv").write_bytes('﻿"role","n"\nü,7\n'.encode())
    (tmp_path / "q" / "e.csv").write_bytes("role,n\n\xfc,8\n".encode("latin-1"))
    typed = delimited.read_delimited(spark, str(tmp_path / "q"), "role string, n int")
    assert sorted(map(tuple, typed.collect())) == [("ü", 7), ("ü", 8)]


def test_four_layouts_to_records(spark, tmp_path):
    workbook(tmp_path / "one.xlsx", [["job_title", "job_description", "company", "location_normalized", "seniority"], ["Dev", "writes", "Acme", "Here", None]])
    workbook(tmp_path / "two.xlsx", [["job_title", "job_description", "skills_required", "salary_vnd", "category"], ["Ops", "runs", " SQL, ,Git ", 5, "it"], ["Lead", "leads", " , ", None, None]])
    (tmp_path / "jd.csv").write_bytes("Job Title,Description\nAnalyst,caf\xe9\n".encode("latin-1"))
    (tmp_path / "cv.csv").write_text("ID,Resume_str,Resume_html,Category\n12,text,<b>,HR\n11,text,<b>,IT\n")
    got = records.all_records(
        {
            "LINKEDIN": (workbooks.read_workbook(spark, str(tmp_path / "one.xlsx")), ["job_title"]),
            "TOPCV": (workbooks.read_workbook(spark, str(tmp_path / "two.xlsx")), ["job_title"]),
            "JD": (tables.read_csv(spark, str(tmp_path / "jd.csv")), ["Job Title"]),
            "RESUME": (tables.read_csv(spark, str(tmp_path / "cv.csv")), ["ID"]),
        }
    )
    rows = {r.record_id: r for r in got.collect()}
    assert set(rows) == {"LINKEDIN_0001", "TOPCV_0001", "TOPCV_0002", "JD_0001", "RESUME_0001", "RESUME_0002"}
    assert rows["LINKEDIN_0001"].metadata.company == "Acme" and rows["LINKEDIN_0001"].skills_raw is None and rows["LINKEDIN_0001"].category is None
    assert rows["TOPCV_0002"].skills_raw == ["SQL", "Git"] and rows["TOPCV_0001"].skills_raw is None and rows["TOPCV_0002"].metadata.salary_vnd == "5"
    assert rows["JD_0001"].description == "café" and rows["JD_0001"].source == "KAGGLE_JD"
    assert rows["RESUME_0001"].title == "IT" == rows["RESUME_0001"].category and rows["RESUME_0001"].metadata.original_id == "11" and rows["RESUME_0001"].record_type == "resume"


@pytest.mark.parametrize("range_rows", [100_000, 130, 7])
def test_numbers_in_order(spark, range_rows):
    r = random.Random(range_rows)
    rows = [(r.choice([None, *range(40)]), r.choice(["a", "b", None]), i, {"m": i}) for i in range(1500)] + [(5, "hot", 0, {"m": 0})] * 500
    df = spark.createDataFrame(rows, "k int, s string, v int, m map<string,int>").repartition(7)
    got, n = numbering.numbered(df, ["k", "s"], "n", range_rows)
    found = sorted(got.collect(), key=lambda x: x.n)
    assert n == 2000 and [x.n for x in found] == list(range(1, 2001))
    key = lambda x: (x.k is not None, x.k or 0, x.s is not None, x.s or "")
    assert [key(x) for x in found] == sorted(map(key, found))
    again = {(x.k, x.s, x.v, x.n) for x in numbering.numbered(df.repartition(3), ["k", "s"], "n", range_rows)[0].collect()}
    assert again == {(x.k, x.s, x.v, x.n) for x in found}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "specifiedwindowframe" in plan and "Window [row_number() windowspecdefinition(_key" not in plan
    assert numbering.numbered(df.limit(0), ["k"])[0].count() == 0
