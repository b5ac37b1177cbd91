"""Cells as Spark columns: types, normalisation, equality, text forms.

A column of one static type stays as it is (`Typed` with its tag); a column of mixed cells, as XLSX has them,
is a struct with the tag of each cell.  Both have the same operations.
"""

from __future__ import annotations

import datetime
import decimal
import json
import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALAR = "type:string,num:double,str:string,bool:boolean,ts:timestamp"
CELL = f"struct<{SCALAR},formula:string,result:struct<{SCALAR}>,target:string,tooltip:string>"
#: Fixed value: the characters that a trim removes.
SPACE = "\\u0009-\\u000D\\u0020\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


class Typed(NamedTuple):
    """A column's value and its tag: string, number, boolean, date, or cell for a struct of mixed cells."""

    value: Column
    tag: str

    @property
    def blank(self) -> Column:
        return self.value["type"] == "blank" if self.tag == "cell" else self.value.isNull()

    @property
    def type(self) -> Column:
        return self.value["type"] if self.tag == "cell" else F.when(self.value.isNull(), "blank").otherwise(self.tag)

    def part(self, tag: str) -> Column:
        """The payload where the cell has the tag, else null."""
        if self.tag == "cell":
            field = {"number": "num", "boolean": "bool", "date": "ts"}.get(tag, "str")
            return F.when(self.value["type"] == tag, self.value[field])
        return self.value if self.tag == tag else F.lit(None)


def tag_of(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "cell" if isinstance(kind, T.StructType) and kind.fieldNames()[:1] == ["type"] else "string"


def text_rule(text: Column, rule: dict) -> Column:
    """Trim, then case; '' is judged before the trim.  Without a rule, the column itself."""
    out = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "") if rule.get("trim") else text
    out = F.lower(out) if rule.get("caseSensitive") is False else out
    return F.when(text != "", out) if rule.get("emptyEqualsNull") else out


def number_rule(value: Column) -> Column:
    """-0 is 0; what isn't finite is an error."""
    wrong = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(wrong, F.raise_error(F.lit("driftframe:INPUT_ERROR:number must be finite:driftframe")).cast("double")).otherwise(value + F.lit(0.0))


def normalise(value: Column, kind: T.DataType, rule: dict) -> Typed:
    tag = tag_of(kind)
    if tag == "cell":
        return Typed(normalise_cell(value, rule), tag)
    if tag == "string":
        return Typed(text_rule(value.cast("string"), rule), tag)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Typed(number_rule(value.cast("double")), tag)
    if isinstance(kind, T.DecimalType):
        return Typed(value.cast("double"), tag)
    if isinstance(kind, T.DateType):
        return Typed(value.cast("timestamp_ntz"), tag)
    return Typed(value, tag)


def unchecked(value: Column, kind: T.DataType, rule: dict) -> Typed:
    """normalise() for filters: numbers as they are, so that a filter reaches the scan.

    Rows that a filter leaves out aren't checked for numbers that aren't finite."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Typed(value.cast("double"), "number")
    return normalise(value, kind, rule)


def _scalar(cell: Column, rule: dict, fields: tuple[str, ...] = ("type", "num", "str", "bool", "ts")) -> dict[str, Column]:
    text = text_rule(cell["str"], rule)
    is_text = cell["type"] == "string"
    type_ = F.when(is_text & text.isNull(), "blank").otherwise(F.coalesce(cell["type"], F.lit("blank")))
    values = {"type": type_, "num": cell["num"] + F.lit(0.0), "str": F.when(is_text | (cell["type"] == "hyperlink"), text).otherwise(cell["str"]), "bool": cell["bool"], "ts": cell["ts"]}
    return {f: values[f] for f in fields}


def normalise_cell(cell: Column, rule: dict) -> Column:
    """A mixed cell under a rule; a formula keeps its text, its result or both."""
    own = _scalar(cell, rule)
    result = F.struct(*(v.alias(k) for k, v in _scalar(cell["result"], rule).items()))
    none = F.lit(None)
    mode = rule.get("formulaMode", "formula-and-cached-result")
    is_formula = cell["type"] == "formula"
    empty = none.cast(f"struct<{SCALAR}>")
    plain = F.struct(*(v.alias(k) for k, v in own.items()), none.cast("string").alias("formula"), empty.alias("result"), cell["target"].alias("target"), cell["tooltip"].alias("tooltip"))
    if mode == "cached-result":
        known = F.struct(*(result[k].alias(k) for k in ("type", "num", "str", "bool", "ts")), none.cast("string").alias("formula"), empty.alias("result"), none.cast("string").alias("target"), none.cast("string").alias("tooltip"))
    else:
        kept = result if mode == "formula-and-cached-result" else empty
        known = F.struct(F.lit("formula").alias("type"), none.cast("double").alias("num"), none.cast("string").alias("str"), none.cast("boolean").alias("bool"), none.cast("timestamp").alias("ts"), cell["formula"].alias("formula"), kept.alias("result"), none.cast("string").alias("target"), none.cast("string").alias("tooltip"))
    return F.when(is_formula, known).otherwise(plain).cast(CELL)


def equal(a: Typed, b: Typed, rule: dict) -> Column:
    """Two-valued equality; numbers within the rule's tolerance are equal."""
    same = a.value.eqNullSafe(b.value) if a.tag == b.tag else (a.blank & b.blank)
    if "numericTolerance" not in rule or "number" not in (a.tag, "number") or not ({a.tag, b.tag} <= {"number", "cell"}):
        return same
    x, y = a.part("number"), b.part("number")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= F.lit(float(rule["numericTolerance"]))).otherwise(same)


def to_cell(x: Typed) -> Column:
    """Any typed column as a cell struct."""
    if x.tag == "cell":
        return x.value

    def only(tag: str, kind: str) -> Column:
        return x.value.cast(kind) if x.tag == tag else F.lit(None).cast(kind)

    empty = F.lit(None).cast(f"struct<{SCALAR}>")
    parts = (x.type.alias("type"), only("number", "double").alias("num"), only("string", "string").alias("str"), only("boolean", "boolean").alias("bool"), only("date", "timestamp").alias("ts"))
    return F.struct(*parts, F.lit(None).cast("string").alias("formula"), empty.alias("result"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("tooltip")).cast(CELL)


# ---- on the driver: collected cells as [type, payload]


def number_text(x: float) -> str:
    """A double as ECMAScript prints it."""
    if x == 0:
        return "0"
    if math.isfinite(x) and x == int(x) and abs(x) < 1e21:
        digits = repr(abs(x))
        return ("-" if x < 0 else "") + format(decimal.Decimal(digits), "f").removesuffix(".0")
    sign, digits, exponent = decimal.Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(digits) + exponent
    out = "-" if sign else ""
    if 0 < point <= 21:
        return out + (text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}")
    if -6 < point <= 0:
        return f"{out}0.{'0' * -point}{text}"
    mantissa = text[0] + ("." + text[1:] if len(text) > 1 else "")
    return f"{out}{mantissa}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def date_text(x: datetime.datetime) -> str:
    return x.strftime("%Y-%m-%dT%H:%M:%S.") + f"{x.microsecond // 1000:03d}Z"


def typed(cell) -> list:
    """A collected cell struct as [type, payload]."""
    kind = cell["type"]
    if kind == "blank":
        return ["blank", None]
    if kind == "number":
        return ["number", cell["num"]]
    if kind == "boolean":
        return ["boolean", cell["bool"]]
    if kind == "date":
        return ["date", date_text(cell["ts"])]
    if kind == "hyperlink":
        return ["hyperlink", {"text": ["string", cell["str"]], "target": cell["target"], "tooltip": cell["tooltip"]}]
    if kind == "formula":
        return ["formula", cell["formula"] if cell["result"] is None else [cell["formula"], typed(cell["result"])]]
    return [kind, cell["str"]]


def js_json(value) -> str:
    """JSON as ECMAScript writes it: no spaces, plain non-ASCII, its own numbers."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number_text(float(value)) if math.isfinite(value) else "null"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False).replace("\x7f", "\x7f")
    if isinstance(value, dict):
        return "{" + ",".join(f"{js_json(k)}:{js_json(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(js_json, value)) + "]"


def print_value(cell: list) -> str:
    """Display text of a typed value."""
    kind, value = cell
    if kind == "blank":
        return ""
    if kind == "formula" or isinstance(value, (dict, list)):
        return js_json(value)
    return number_text(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else js_json(value) if isinstance(value, bool) else str(value)
