"""Workbooks with shared strings, dates and gaps; Stata files with labels and missing values; exports with bad records."""

import datetime
import io
import zipfile

import pandas as pd
import pytest

from concordat.sources import office

M, R = office.MAIN[1:-1], office.LINK[1:-1]


def book(sheet, shared="", styles=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{M}" xmlns:r="{R}"><sheets><sheet name="one" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{M}"><sheetData>{sheet}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{M}">{shared}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{M}">{styles}</styleSheet>')
    return out.getvalue()


SHEET = """<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="AB1" t="inlineStr"><is><t>far</t></is></c></row><row/>
<row><c r="A2"><v>1.5</v></c><c r="C2" s="2"><v>36526</v></c><c r="AB2" t="b"><v>1</v></c></row><row><c r="C3" t="str"><v>text</v></c><c r="A3"><v>7</v></c></row>"""
SHARED = "<si><t>num</t></si><si><r><t>wh</t></r><r><t>en</t></r></si>"
STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'


def test_sheets(spark):
    rows = list(office.sheet_rows(book(SHEET, SHARED, STYLES)))
    assert rows[0][0] == "num" and rows[0][2] == "when" and rows[0][27] == "far" and rows[1] == []
    assert rows[2][:3] == [1.5, None, datetime.datetime(2000, 1, 1)] and rows[2][27] is True and rows[3] == [7, None, "text"]
    with pytest.raises(ValueError, match="no sheet two"):
        list(office.sheet_rows(book(SHEET, SHARED), "two"))
    table = spark.createDataFrame([("p", book(SHEET, SHARED, STYLES)), ("q", book(""))], "path string, content binary")
    found = sorted(map(tuple, office.read_excel(table, "when date, num double, far boolean, none int").collect()), key=lambda r: r[1])
    assert found == [(datetime.date(2000, 1, 1), 1.5, True, None, "p"), (None, 7.0, None, None, "p")]


def test_stata(spark, tmp_path):
    data = pd.DataFrame({"name": ["a", "", "é"], "kind": pd.Categorical(["x", "y", None]), "v": [1.0, None, 3.0], "day": pd.to_datetime(["2001-02-03", None, "2004-05-06"])})
    data.to_stata(f"{tmp_path}/t.dta", write_index=False, version=118, convert_dates={"day": "td"})
    found = office.read_stata(office.files(spark, f"{tmp_path}/*.dta"), "v double, name string, kind string").collect()
    assert [tuple(r)[:3] for r in found] == [(1.0, "a", "x"), (None, None, "y"), (3.0, "é", None)] and found[0]["path"].endswith("t.dta")


def test_export(spark):
    rows = [("a", '{"text": "1"}'), ("a", '{"text": "2"}'), ("b", "{"), ("c", '{"text": null}'), (None, '{"text": "x"}'), ("d", None), ("e", "[1]"), ("f", '{"text": ""}')]
    found = office.export_sqlite(spark.createDataFrame(rows, "k string, j string"), "k", "j", shards=3)
    assert sum(r.inserted for r in found.collect()) == 2 and sum(r.skipped for r in found.collect()) == 5
    assert sorted(map(tuple, office.read_sqlite(found).collect())) == [("a", "2"), ("f", "")]
    assert office.export_sqlite(spark.createDataFrame([], "k string, j string"), "k", "j").count() == 0
