"""A small writer of test workbooks: rows of str, float, bool, None or raw cell XML."""

import zipfile
from xml.sax.saxutils import escape

from driftframe.sources.xlsx import column_letters

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def cell(value, ref: str) -> str:
    if value is None:
        return ""
    if isinstance(value, str) and value.startswith("<c "):
        return value.replace("<c ", f'<c r="{ref}" ', 1)
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'


def write(path, rows, sheet="data", extra="", rels="", strings=None, hidden=()):
    body = "".join(f'<row r="{n}">{"".join(cell(v, f"{column_letters(i)}{n}") for i, v in enumerate(row, 1))}</row>' for n, row in enumerate(rows, 1) if row is not None)
    names = [sheet, *hidden]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" {"" if i == 1 else "state=\"hidden\""} r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        for i in range(1, len(names) + 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData>{body if i == 1 else ""}</sheetData>{extra if i == 1 else ""}</worksheet>')
        if rels:
            z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships xmlns="x">{rels}</Relationships>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
    return str(path)
