"""Workbooks made by hand from the parts of the file format."""

import zipfile

import pytest

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINKS = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, rows, shared=(), styles="", setting=""):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} {LINKS}>{setting}<sheets><sheet name="other" r:id="rId7"/><sheet name="x" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet9.xml"/><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet9.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si>{s}</si>' for s in shared)}</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")


STYLES = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="171" formatCode="0.0&quot; days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'


def test_cells_of_every_kind(spark, tmp_path):
    from rillmap.sources.loader import load_table

    shared = ["<t>id</t>", "<t>title</t>", "<r><t>a </t></r><r><t>rich, 한글</t></r><rPh><t>hint</t></rPh>"]
    rows = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>title</t></is></c></row>
    <row r="2"><c r="A2"><v>1</v></c><c r="B2" t="s"><v>2</v></c><c r="C2" s="1"><v>36526</v></c><c r="D2" s="2"><v>36526.5</v></c><c r="E2"><v>9</v></c></row>
    <row r="3"/><row r="4"><c r="A4"><v>2.5</v></c><c r="B4" t="e"><v>#N/A</v></c><c r="C4" s="3"><v>36526</v></c><c r="D4" t="b"><v>1</v></c></row>
    <row r="5"><c r="B5" t="str"><v>formula</v></c></row>"""
    workbook(tmp_path / "a.xlsx", rows, shared, STYLES)
    df, facts = load_table(spark, str(tmp_path / "a.xlsx"))
    assert facts == {"format": "excel"} and df.columns == ["id", "title", "Unnamed: 2", "title.1"]
    assert [tuple(r) for r in df.collect()] == [("1", "a rich, 한글", "2000-01-01", "2000-01-01 12:00:00"), ("2.5", None, "36526", "True"), (None, "formula", None, None)]
    assert df.select("id").count() == df.count() == 3


def test_many_workbooks_and_none(spark, tmp_path):
    from rillmap.sources.loader import load_table
    from rillmap.sources.workbook import read_workbooks

    for k in range(3):
        cells = "".join(f'<row><c t="inlineStr"><is><t>n{i}</t></is></c><c><v>{k}</v></c></row>' for i in range(1, 6))
        workbook(tmp_path / f"{k}.xlsx", f'<row><c t="inlineStr"><is><t>name</t></is></c><c t="inlineStr"><is><t>n</t></is></c></row>{cells}')
    assert sorted(map(tuple, read_workbooks(spark, str(tmp_path)).collect())) == sorted((f"n{i}", str(k)) for k in range(3) for i in range(1, 6))
    (tmp_path / "none").mkdir()
    workbook(tmp_path / "none" / "e.xlsx", "", setting='<workbookPr date1904="1"/>')
    assert load_table(spark, str(tmp_path / "none" / "e.xlsx"))[0].count() == 0
    with pytest.raises(ValueError, match="xlsx"):
        load_table(spark, str(tmp_path / "old.xls"))
