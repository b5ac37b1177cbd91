"""XLSX sheets as rows of typed cells, read as a stream from the zip container.

``scan`` distributes the reading: workbooks come through Spark's binary files, so any store that Spark reads will do,
one task each (a zip member can't be split), and only the wanted columns leave it.  A task holds the workbook's file
(2 GB at most), one row of its sheet, and its shared strings in compressed blocks.
"""

from __future__ import annotations

import datetime
import io
import json
import re
import zipfile
import zlib
from posixpath import join, normpath
from typing import NamedTuple
from xml.etree.ElementTree import iterparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, tag
from ..functions.cells import CELL
from .tables import CELLS, ROW, Version

REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Ids of the built-in number formats that show dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


class Cell(NamedTuple):
    """kind: blank, number, string, boolean, date, error, hyperlink, formula; value by kind."""

    kind: str
    value: object = None
    formula: str | None = None
    result: Cell | None = None
    target: str | None = None
    tooltip: str | None = None


BLANK = Cell("blank")


def local(tag_name: str) -> str:
    return tag_name.rpartition("}")[2]


def column_number(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + ord(ch) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


REFERENCE = re.compile(r"\$?([A-Z]{1,3})\$?(\d+)")


def split_reference(ref: str) -> tuple[int, int]:
    m = REFERENCE.fullmatch(ref)
    if not m:
        raise ValueError("bad cell reference")
    return column_number(m[1]), int(m[2])


def in_range(column: int, row: int, ref: str) -> bool:
    first, _, last = ref.partition(":")
    (c1, r1), (c2, r2) = split_reference(first), split_reference(last or first)
    return c1 <= column <= c2 and r1 <= row <= r2


#: A reference in a formula, not inside quotes and not part of a name or a call.
IN_FORMULA = re.compile(r"""("(?:[^"]|"")*"|'(?:[^']|'')*')|(?<![A-Za-z0-9_.$])(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(.])""")


def shift_formula(formula: str, columns: int, rows: int) -> str:
    """The formula as its follower so many columns and rows away has it; what has a $ stays."""

    def moved(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        column = m[3] if m[2] else column_letters(column_number(m[3]) + columns)
        row = m[5] if m[4] else str(int(m[5]) + rows)
        return f"{m[2]}{column}{m[4]}{row}"

    return IN_FORMULA.sub(moved, formula)


def is_date_format(number_format: str) -> bool:
    """Whether a format code shows a date or a time."""
    bare = re.sub(r'\[[^\]]*\]|"[^"]*"|\\.|_.|\*.', "", number_format)
    return bool(re.search("[ymdhsYMDHS]", bare)) and bare.lower() != "general"


def excel_date(serial: float, epoch_1904: bool) -> datetime.datetime:
    """A serial day as a time, to the millisecond; day 60 of the 1900 system doesn't exist."""
    base = datetime.datetime(1904, 1, 1) if epoch_1904 else datetime.datetime(1899, 12, 30) if serial >= 60 else datetime.datetime(1899, 12, 31)
    return base + datetime.timedelta(milliseconds=round(serial * 86_400_000))


class Sheet(NamedTuple):
    name: str
    visibility: str
    path: str


class Strings:
    """Texts by number in little memory: compressed in blocks, of which the latest read are open."""

    BLOCK, OPEN = 2048, 64

    def __init__(self, texts):
        self.blocks: list[bytes] = []
        self.n = 0
        self.open: dict[int, list[str]] = {}
        block: list[str] = []
        for text in texts:
            block.append(text)
            self.n += 1
            if len(block) == self.BLOCK:
                self._close(block)
                block = []
        if block:
            self._close(block)

    def _close(self, block: list[str]) -> None:
        self.blocks.append(zlib.compress(json.dumps(block).encode(), 1))

    def __getitem__(self, i: int) -> str:
        if not 0 <= i < self.n:
            raise ValueError("no such shared string")
        number, place = divmod(i, self.BLOCK)
        block = self.open.pop(number, None)
        if block is None:
            block = json.loads(zlib.decompress(self.blocks[number]))
            if len(self.open) >= self.OPEN:
                del self.open[next(iter(self.open))]
        self.open[number] = block  # the latest last
        return block[place]


class Workbook:
    """An open workbook: catalogue of sheets, shared strings, date formats."""

    def __init__(self, source):
        self.zip = zipfile.ZipFile(source)
        self.names = {n.lstrip("/"): n for n in self.zip.namelist()}
        self.epoch_1904 = False
        relations = {rid: target for rid, target, _ in self.relations("xl/workbook.xml")}
        self.sheets: list[Sheet] = []
        for element in self.elements("xl/workbook.xml"):
            if local(element.tag) == "sheet":
                self.sheets.append(Sheet(element.get("name"), element.get("state") or "visible", relations.get(element.get(REL + "id"), "")))
            elif local(element.tag) == "workbookPr":
                self.epoch_1904 = element.get("date1904") in ("1", "true")
        self.strings: Strings | None = None
        self.date_styles: list[bool] | None = None

    def open(self, name: str):
        return self.zip.open(self.names[name])

    def elements(self, name: str, forget: tuple[str, ...] = ()):
        """Elements as they end.  Those of the names to forget, and what is in them, leave the tree once they were used."""
        if name not in self.names:
            return
        with self.open(name) as f:
            parents = []
            for event, element in iterparse(f, ("start", "end")):
                if event == "start":
                    parents.append(element)
                    continue
                parents.pop()
                yield element
                if parents and local(element.tag) in forget:
                    parents[-1].remove(element)

    def relations(self, part: str) -> list[tuple[str, str, str]]:
        folder, _, name = part.rpartition("/")
        out = []
        for x in self.elements(f"{folder}/_rels/{name}.rels"):
            if local(x.tag) == "Relationship":
                target = x.get("Target")
                if x.get("TargetMode") != "External":
                    target = target.lstrip("/") if target.startswith("/") else normpath(join(folder, target))
                out.append((x.get("Id"), target, x.get("TargetMode") or ""))
        return out

    def shared_strings(self) -> Strings:
        """Texts of the shared strings (runs of rich text joined, phonetic hints left out)."""
        if self.strings is None:
            self.strings = Strings(text_of(x) for x in self.elements("xl/sharedStrings.xml", ("si",)) if local(x.tag) == "si")
        return self.strings

    def dates(self) -> list[bool]:
        if self.date_styles is None:
            formats, self.date_styles = {}, []
            for x in self.elements("xl/styles.xml"):
                if local(x.tag) == "numFmt":
                    formats[int(x.get("numFmtId"))] = x.get("formatCode") or ""
                elif local(x.tag) == "cellXfs":
                    ids = [int(xf.get("numFmtId") or 0) for xf in x]
                    self.date_styles = [is_date_format(formats[i]) if i in formats else i in DATE_FORMATS for i in ids]
        return self.date_styles

    def sheet(self, name: str) -> Sheet:
        found = next((s for s in self.sheets if s.name == name), None)
        if found is None:
            raise LookupError(", ".join(s.name for s in self.sheets))
        return found

    def hyperlinks(self, sheet: Sheet) -> dict[str, tuple[str, str | None]]:
        """Cell reference -> target and tooltip, of links to outside whose reference is one cell."""
        targets = {rid: target for rid, target, mode in self.relations(sheet.path) if mode == "External"}
        if not targets:
            return {}
        return {x.get("ref"): (targets[x.get(REL + "id")], x.get("tooltip")) for x in self.elements(sheet.path, ("row",)) if local(x.tag) == "hyperlink" and x.get(REL + "id") in targets}


def text_of(element) -> str:
    out = []
    for child in element:
        name = local(child.tag)
        if name == "t":
            out.append(child.text or "")
        elif name == "r":
            out += [t.text or "" for t in child if local(t.tag) == "t"]
    return "".join(out)


class SheetReader:
    """Rows of a sheet as (number, cells by column number); counts merged ranges and formula cells."""

    def __init__(self, book: Workbook, name: str):
        self.book, self.sheet = book, book.sheet(name)
        self.merges = self.formulas = 0

    def rows(self):
        book, links = self.book, self.book.hyperlinks(self.sheet)
        masters: dict[str, tuple[str, int, int, str]] = {}
        row_number = 0
        for element in book.elements(self.sheet.path, ("row",)):
            name = local(element.tag)
            if name == "mergeCell":
                self.merges += 1
            elif name == "row":
                row_number = int(element.get("r") or row_number + 1)
                cells, column = {}, 0
                for c in element:
                    if local(c.tag) != "c":
                        continue
                    if c.get("r"):
                        column, _ = split_reference(c.get("r"))
                    else:
                        column += 1
                    cells[column] = self.cell(c, column, row_number, masters, links)
                masters = {k: v for k, v in masters.items() if split_reference(v[3].rpartition(":")[2])[1] > row_number}
                yield row_number, cells

    def cell(self, c, column: int, row: int, masters: dict, links: dict) -> Cell:
        parts = {local(x.tag): x for x in c}
        kind = c.get("t") or "n"
        text = parts["v"].text if "v" in parts else None
        value = self.value(kind, text, parts.get("is"), int(c.get("s") or 0))
        formula = None
        if "f" in parts:
            formula = self.formula(parts["f"], column, row, masters)
            self.formulas += 1
        link = links.get(f"{column_letters(column)}{row}")
        if link and value.kind != "blank":
            shown = value.value if value.kind in ("string", "error") else "" if value.value is None else _plain(value.value)
            return Cell("hyperlink", shown, target=link[0], tooltip=link[1])
        if formula is not None:
            return Cell("formula", formula=formula, result=value)
        return value

    def formula(self, f, column: int, row: int, masters: dict) -> str:
        if f.get("t") == "shared":
            if f.text:
                masters[f.get("si")] = f.text, column, row, f.get("ref") or f"{column_letters(column)}{row}"
                return f.text
            if f.get("si") not in masters:
                raise ValueError("shared formula without a master")
            text, c0, r0, ref = masters[f.get("si")]
            if not in_range(column, row, ref):
                raise ValueError("shared formula outside its range")
            return shift_formula(text, column - c0, row - r0)
        return f.text or ""

    def value(self, kind: str, text: str | None, inline, style: int) -> Cell:
        if kind == "inlineStr":
            return BLANK if inline is None else Cell("string", text_of(inline))
        if text is None:
            return BLANK
        if kind == "s":
            return Cell("string", self.book.shared_strings()[int(text)])
        if kind == "str":
            return Cell("string", text)
        if kind == "b":
            return Cell("boolean", text == "1")
        if kind == "e":
            return Cell("error", text)
        if kind == "d":
            moment = datetime.datetime.fromisoformat(text.replace("Z", "+00:00"))
            return Cell("date", moment.astimezone(datetime.UTC).replace(tzinfo=None) if moment.tzinfo else moment)
        number = float(text)
        dates = self.book.dates()
        if style < len(dates) and dates[style]:
            return Cell("date", excel_date(number, self.book.epoch_1904))
        return Cell("number", number)


def _plain(value) -> str:
    from ..functions.cells import date_text, number_text

    if isinstance(value, bool):
        return "true" if value else "false"
    return date_text(value) if isinstance(value, datetime.datetime) else number_text(value)


def header_texts(cells: dict[int, Cell]) -> list[str | None]:
    """Header text of each column from 1."""
    out: list[str | None] = []
    for i in range(1, max(cells, default=0) + 1):
        cell = cells.get(i, BLANK)
        cell = cell.result if cell.kind == "formula" else cell
        out.append(None if cell.kind == "blank" else cell.value if isinstance(cell.value, str) else _plain(cell.value))
    return out


def data_rows(reader: SheetReader, header_row: int):
    """("header", texts) once, then (row number, cell count, cells); missing physical rows come as blank ones."""
    before, headed = header_row, False
    for number, cells in reader.rows():
        if number < header_row:
            continue
        if number == header_row:
            headed = True
            yield "header", header_texts(cells), None
            continue
        if not headed:
            headed = True
            yield "header", [], None
        for gap in range(before + 1, number):
            yield gap, 0, {}
        yield number, max(cells, default=0), cells
        before = number
    if not headed:
        yield "header", [], None


def as_struct(cell: Cell) -> dict:
    def scalar(x: Cell) -> dict:
        return {"type": x.kind, "num": x.value if x.kind == "number" else None, "str": x.value if x.kind in ("string", "error", "hyperlink") else None, "bool": x.value if x.kind == "boolean" else None, "ts": x.value if x.kind == "date" else None}

    result = scalar(cell.result or BLANK) if cell.kind == "formula" else None
    return scalar(cell) | {"formula": cell.formula, "result": result, "target": cell.target, "tooltip": cell.tooltip}


def _read(data: bytes, file_id: str, sheet: str):
    try:
        return SheetReader(Workbook(io.BytesIO(data)), sheet)
    except LookupError as e:
        raise InputError("SHEET_NOT_FOUND", tag("SHEET_NOT_FOUND", f"sheet {sheet} not found for {file_id}; available: {e.args[0]}")) from None
    except Exception:
        raise InputError("INPUT_ERROR", tag("INPUT_ERROR", f"cannot read XLSX input for {file_id}")) from None


def binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path if "://" in path or path.startswith("file:") else f"file://{path}").select("content")


def read_header(spark: SparkSession, file_id: str, path: str, sheet: str, header_row: int) -> list[str | None]:
    """The header row's texts, read by a task."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                reader = _read(data, file_id, sheet)
                try:
                    texts = next(data_rows(reader, header_row))[1]
                except Exception:
                    raise InputError("INPUT_ERROR", tag("INPUT_ERROR", f"cannot read XLSX input for {file_id}")) from None
                yield pa.RecordBatch.from_arrays([pa.array([texts], pa.list_(pa.string()))], ["texts"])

    return binary(spark, path).mapInArrow(run, "texts array<string>").first()[0]


def scan(spark: SparkSession, file_id: str, path: str, sheet: str, header_row: int, places: list[int]) -> DataFrame:
    """ROW, cell_count and CELLS, the cells at the places wanted, of every row after the header."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for data in batch["content"]:
                reader, rows = _read(data, file_id, sheet), []
                try:
                    for number, count, cells in data_rows(reader, header_row):
                        if number == "header":
                            continue
                        rows.append((number, count, [as_struct(cells.get(p, BLANK)) for p in places]))
                        if len(rows) == 2000:
                            yield pd.DataFrame(rows, columns=[ROW, "cell_count", CELLS])
                            rows = []
                except Exception:
                    raise InputError("INPUT_ERROR", tag("INPUT_ERROR", f"cannot read XLSX input for {file_id}")) from None
                yield pd.DataFrame(rows, columns=[ROW, "cell_count", CELLS])

    return binary(spark, path).mapInPandas(run, f"{ROW} long, cell_count int, {CELLS} array<{CELL}>")


def version(spark: SparkSession, file_id: str, path: str, sheet: str, header_row: int = 1) -> Version:
    """A sheet as a version; every column with a header can be read, those that are selected are."""
    texts = read_header(spark, file_id, path, sheet, header_row)
    places = [i for i, t in enumerate(texts, 1) if t]
    rows = scan(spark, file_id, path, sheet, header_row, places)
    names = [f"c{p}" for p in places]
    frame = rows.select(ROW, "cell_count", *(F.col(CELLS)[i].alias(n) for i, n in enumerate(names)))
    columns = [f"c{i}" for i in range(1, len(texts) + 1)]
    return Version(file_id, frame, texts, columns, sheet)
