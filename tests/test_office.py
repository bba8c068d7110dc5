"""Word, Excel and text files made here are read back; broken ones are rows with an error."""

import zipfile

from tallyforge.sources import office as O

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def _archive(path, parts):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)


def _folder(tmp_path):
    p = lambda *t: f"<w:p>{''.join(f'<w:r><w:t>{x}</w:t></w:r>' for x in t)}</w:p>"
    _archive(tmp_path / "a.docx", {"word/document.xml": f"<w:document {W}><w:body>{p('Hello ', 'Мир')}{p(' ')}<w:tbl><w:tr><w:tc>{p('cell')}</w:tc></w:tr></w:tbl><w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p></w:body></w:document>"})
    row = lambda n, *c: f'<row r="{n}">{"".join(c)}</row>'
    sheet = f'<worksheet {S}><sheetData>{row(1, "<c r=\'A1\' t=\'s\'><v>0</v></c>")}{row(2, "<c r=\'A2\' t=\'s\'><v>1</v></c>", "<c r=\'C2\'><v>12.5</v></c>")}{row(3, "<c r=\'B3\' t=\'inlineStr\'><is><t> in </t><t>line</t></is></c>")}{row(4, "<c r=\'D4\'><v>1</v></c>")}{row(5)}</sheetData></worksheet>'
    shared = f"<sst {S}><si><t>Name</t></si><si><r><t>Ba</t></r><r><t>nner</t></r></si></sst>"
    _archive(tmp_path / "t.xlsx", {"xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": shared})
    (tmp_path / "broken.xlsx").write_bytes(b"no archive")
    (tmp_path / "broken.docx").write_bytes(b"PK\x03\x04 cut")
    (tmp_path / "u.txt").write_text("﻿Привет", encoding="utf-8")
    (tmp_path / "c.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "empty.txt").write_bytes(b"")
    (tmp_path / "large.txt").write_bytes(b"x" * 5000)
    (tmp_path / "other.bin").write_bytes(b"x")


def test_texts(spark, tmp_path):
    _folder(tmp_path)
    rows = {r.path.rsplit("/", 1)[1]: r for r in O.read_texts(spark, str(tmp_path), most=4000).collect()}
    assert {k: r.text for k, r in rows.items()} == {"a.docx": "Hello Мир\ncell\nx\ty", "broken.docx": None, "u.txt": "Привет", "c.txt": "Привет", "large.txt": None}
    assert rows["broken.docx"].error.startswith("BadZipFile") and "too large" in rows["large.txt"].error and rows["a.docx"].error is None


def test_sheets(spark, tmp_path):
    _folder(tmp_path)
    rows = O.read_sheets(spark, str(tmp_path), ["name", "note", "price"]).orderBy("path", "row").collect()
    assert [(r.row, r.name, r.note, r.price) for r in rows if r.error is None] == [(2, "Banner", None, "12.5"), (3, None, "in line", None)]
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["broken.xlsx"]
    assert [r.row for r in O.read_sheets(spark, str(tmp_path), ["name", "note", "price"], useful=["price"]).collect() if r.error is None] == [2]


def test_large_files_are_pruned_in_the_scan(spark, tmp_path):
    _folder(tmp_path)
    plan = O.read_texts(spark, str(tmp_path), most=4000)._jdf.queryExecution().toString()
    assert any("PushedFilters" in x and "LessThanOrEqual(length,4000)" in x for x in plan.split("\n"))
