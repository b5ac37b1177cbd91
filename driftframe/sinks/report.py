"""Report files of a comparison: CSV and JSON in a directory that appears at once, or not at all."""

from __future__ import annotations

import datetime
import errno
import os
import re
import shutil
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import js_json, number_text, typed

#: Fixed value: beginnings of a text that a spreadsheet might run, or that this encoding uses itself.
RISKY = re.compile(r"[=+\-@\t\r\n]|json:")


def csv_cell(value) -> str:
    text = "" if value is None else str(value)
    return '"' + text.replace('"', '""') + '"' if re.search('[,"\r\n]', text) else text


def csv_line(values) -> str:
    return ",".join(map(csv_cell, values)) + "\n"


def safe_text(text: str) -> str:
    return "json:" + js_json(text) if RISKY.match(text) else text


def untyped(cell: list):
    """A typed value without its tags."""
    kind, value = cell
    if kind == "blank":
        return ""
    if kind == "formula" and isinstance(value, list):
        return {"formula": value[0], "result": untyped(value[1])}
    return value | {"text": untyped(value["text"])} if kind == "hyperlink" else value


def safe_value(value) -> str:
    if isinstance(value, (dict, list)):
        return safe_text(js_json(value))
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return safe_text(number_text(float(value)))
    return safe_text("" if value is None else value)


def display_key(key: list[list]) -> str:
    values = [untyped(x) for x in key]
    return safe_value(values[0] if len(values) == 1 else values)


def encoded(cells) -> str:
    """The text that identifies a list of typed cells."""
    return js_json([typed(c) for c in cells])


def ordered(df: DataFrame, cells: str, *more: str, first=None) -> DataFrame:
    """Sorted by the encoding of a column of cells, by UTF-16 code units, then by other columns.

    first: bytes that come before the encoding, as a function of the encoded text."""

    @F.pandas_udf("binary")
    def code_units(keys):
        import pandas as pd

        texts = [encoded(_rows(k)) for k in keys]
        return pd.Series([(first(x) if first else b"") + x.encode("utf-16-be", "surrogatepass") for x in texts])

    return df.withColumn("__order", code_units(as_json(cells))).orderBy("__order", *more)


def as_json(cells: str):
    return F.to_json(F.struct(F.col(cells).alias("k")), {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})


def _rows(text: str):
    import json

    def stamp(cell):
        if cell and cell.get("ts"):
            cell["ts"] = datetime.datetime.fromisoformat(cell["ts"].replace("Z", "+00:00")).replace(tzinfo=None)
        if cell and cell.get("result"):
            stamp(cell["result"])
        return cell

    return [stamp(c) for c in json.loads(text)["k"]]


def run_id() -> str:
    return datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ-") + uuid.uuid4().hex[:8]


class ReportWriter:
    """Writes rows into a hidden directory; complete() or abort() publishes it under its run id."""

    def __init__(self, directory: str, ids: list[str], mode: str):
        self.directory, self.ids, self.first_id = directory, ids, run_id()
        os.makedirs(directory, exist_ok=True)
        self.staging = os.path.join(directory, f".{self.first_id}.tmp")
        os.mkdir(self.staging)
        if mode == "multiset":
            heads = {"multiset": ["values", "sheet", *(safe_text(f"{i}.count") for i in ids), "baselineRelation"]}
        else:
            heads = {
                "changed": ["key", "sheet", "column", *(safe_text(f"{i}.{x}") for i in ids for x in ("value", "type", "row"))],
                "missing": ["key", "sheet", "presentFiles", "missingFiles", "baselineRelation"],
                "duplicates": ["key", "files"],
            }
        self.artifacts = {name: "duplicate-keys.csv" if name == "duplicates" else f"{name}.csv" for name in heads}
        self.files = {name: open(os.path.join(self.staging, file), "w", encoding="utf-8", newline="", errors="surrogatepass") for name, file in self.artifacts.items()}
        for name, head in heads.items():
            self.files[name].write(csv_line(head))

    def changed(self, item: dict) -> None:
        values = [x for f in item["files"].values() for x in (safe_value(untyped(f["value"])), safe_text(f["value"][0]), f["rowNumber"])]
        self._line("changed", [display_key(item["key"]), safe_text(item["sheetName"]), safe_text(item["column"]), *values])

    def missing(self, item: dict) -> None:
        self._line("missing", [display_key(item["key"]), safe_text(item["sheetName"]), js_json(item["presentFiles"]), js_json(item["missingFiles"]), item["baselineRelation"]])

    def duplicate(self, item: dict) -> None:
        self._line("duplicates", [display_key(item["key"]), js_json(item["files"])])

    def multiset(self, item: dict) -> None:
        self._line("multiset", [safe_value([untyped(v) for v in item["values"]]), safe_text(item["sheetName"]), *item["counts"].values(), item["baselineRelation"]])

    def _line(self, name: str, values: list) -> None:
        self.files[name].write(csv_line(values))

    def complete(self, summary: dict) -> dict:
        for f in self.files.values():
            f.close()
        return self._publish(summary | {"status": "COMPLETED", "artifacts": self.artifacts})

    def abort(self, error: BaseException) -> dict:
        """Removes what was staged and publishes a summary without any value."""
        for f in self.files.values():
            try:
                f.close()
            except OSError:
                pass
        shutil.rmtree(self.staging, ignore_errors=True)
        os.mkdir(self.staging)
        code = getattr(error, "code", None)
        if isinstance(error, OSError) and error.errno in (errno.ENOSPC, errno.EDQUOT):
            code = "DISK_FULL"
        if not isinstance(code, str) or not re.fullmatch("[A-Z][A-Z0-9_]*", code):
            code = "INTERNAL_ERROR"
        kept = getattr(error, "temp_directory", None)
        return self._publish({"status": "FAILED", "code": code, "message": "comparison failed"} | ({"tempDirectory": kept} if kept else {}))

    def _publish(self, summary: dict) -> dict:
        import json

        name = self.first_id
        while True:
            final = summary | {"runId": name}
            with open(os.path.join(self.staging, "summary.json"), "w", encoding="utf-8") as f:
                f.write(json.dumps(final, indent=2, ensure_ascii=False) + "\n")
            target = os.path.join(self.directory, name)
            if not os.path.lexists(target):
                try:
                    os.rename(self.staging, target)
                    return final | {"directory": target}
                except OSError:
                    if not os.path.lexists(target):
                        raise
            name = run_id()


class Sink(NamedTuple):
    """Callables for the details of a comparison, each called with one item; those that are None aren't called."""

    changed: Callable[[dict], None] | None = None
    missing: Callable[[dict], None] | None = None
    duplicate: Callable[[dict], None] | None = None
    multiset: Callable[[dict], None] | None = None


def items_of(result, ids: list[str]):
    """(sink's field, frame, its key column, other columns to sort by, function from a row to an item)."""

    def cells(values) -> list:
        return [typed(x) for x in values]

    def change(row) -> dict:
        files = {x: {"value": typed(row[f"file{i}"]["value"]), "rowNumber": row[f"file{i}"]["row"]} for i, x in enumerate(ids)}
        return {"key": cells(row["key"]), "sheetName": row["sheet"], "column": row["column"], "files": files}

    def miss(row) -> dict:
        return {"key": cells(row["key"]), "sheetName": row["sheet"], "presentFiles": list(row["presentFiles"]), "missingFiles": list(row["missingFiles"]), "baselineRelation": row["baselineRelation"]}

    def double(row) -> dict:
        return {"key": cells(row["key"]), "files": list(row["files"])}

    def counted(row) -> dict:
        return {"values": cells(row["values"]), "sheetName": row["sheet"], "counts": {x: row[f"count{i}"] for i, x in enumerate(ids)}, "baselineRelation": row["baselineRelation"]}

    yield "changed", result.changed, "key", ("column",), change
    yield "missing", result.missing, "key", (), miss
    yield "duplicate", result.duplicates, "key", (), double
    yield "multiset", result.multiset, "values", (), counted


def emit(result, ids: list[str], sink, check=lambda: None, first=None, by_place: bool = False) -> None:
    """Hands every detail to the sink, in the order of the keys' encodings; rows stream through the driver, not its memory.

    check is called after each item; an error of a sink passes unchanged.  first: see ordered().  by_place: the cells
    of a key come in the order of the columns, not of their names."""
    for field, df, key, more, item in items_of(result, ids):
        take = getattr(sink, field)
        if df is None or take is None:
            continue
        for row in ordered(df, key, *(["place"] if more and by_place else more), first=first).toLocalIterator():
            take(item(row))
            check()
