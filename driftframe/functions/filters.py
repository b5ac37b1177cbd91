"""The filter operators as two-valued Spark predicates; literals are normalised once, on the driver."""

from __future__ import annotations

import datetime
import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cells import SPACE, Typed

DATE = re.compile(r"(\d{4})-(\d\d)-(\d\d)(?:T(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,3}))?)?(Z|[+-]\d\d:\d\d))?")


def date_literal(text: str) -> datetime.datetime | None:
    """A date or a zoned ISO time in UTC; None if it is neither."""
    m = DATE.fullmatch(text)
    if not m:
        return None
    year, month, day, hour, minute, second, fraction, zone = m.groups()
    try:
        offset = datetime.timedelta()
        if zone and zone != "Z":
            hours, minutes = int(zone[1:3]), int(zone[4:])
            if hours > 23 or minutes > 59:
                return None
            offset = datetime.timedelta(hours=hours, minutes=minutes) * (1 if zone[0] == "+" else -1)
        micro = int((fraction or "0").ljust(3, "0")) * 1000
        return datetime.datetime(int(year), int(month), int(day), int(hour or 0), int(minute or 0), int(second or 0), micro) - offset
    except (ValueError, OverflowError):
        return None


def literal(value, rule: dict):
    """(tag, payload) of a literal under the column's rule."""
    if value is None or (rule.get("emptyEqualsNull") and value == ""):
        return "blank", None
    if isinstance(value, bool):
        return "boolean", value
    if isinstance(value, (int, float)):
        return "number", float(value) + 0.0
    text = re.sub(f"^[{SPACE}]+|[{SPACE}]+$", "", value) if rule.get("trim") else value
    return "string", text.lower() if rule.get("caseSensitive") is False else text


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def constant(payload) -> Column:
    """A literal; whole numbers are integers, so that a comparison with an integer column needs no cast."""
    return F.lit(int(payload)) if isinstance(payload, float) and payload.is_integer() and abs(payload) < 1 << 53 else F.lit(payload)


def fails(cell: Typed, f: dict) -> bool:
    """Whether the filter raises an error for some cell: a text that is no date, compared with a date."""
    value = f["value"] if "value" in f else f.get("values")
    values = value if isinstance(value, list) else [value]
    return f["operator"] not in ("isNull", "isNotNull") and cell.tag in ("date", "cell") and any(isinstance(x, str) and date_literal(x) is None for x in values)


def _compare(cell: Typed, value, rule: dict, column: str, how) -> Column:
    """how(payload, literal) where the cell has the literal's tag; a text literal is a date to a date cell.

    Null where the cell is blank, unless the cells are mixed."""
    tag, payload = literal(value, rule)
    out = F.lit(False)
    if tag in ("string", "number", "boolean") and (cell.tag in (tag, "cell")) and not (isinstance(value, str) and cell.tag == "date"):
        out = how(cell.part(tag), constant(payload), tag)
    if isinstance(value, str) and cell.tag in ("date", "cell"):
        moment = date_literal(value)
        if moment is None:
            wrong = F.raise_error(F.lit(f"driftframe:FILTER_INVALID:invalid filter for column {column}:driftframe")).cast("boolean")
            return F.when(cell.type == "date", wrong).otherwise(out)
        stamp = F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")
        if cell.tag == "date":
            return how(cell.value, stamp, "date")
        out = F.when(cell.type == "date", true(how(cell.part("date"), stamp.cast("timestamp"), "date"))).otherwise(out)
    return out


def _equal(cell: Typed, value, rule: dict, column: str) -> Column:
    if literal(value, rule)[0] == "blank":
        return cell.blank
    tolerance = rule.get("numericTolerance")

    def how(a: Column, b: Column, tag: str) -> Column:
        return F.abs(a - b) <= F.lit(float(tolerance)) if tolerance is not None and tag == "number" else a == b

    return _compare(cell, value, rule, column, how)


def _ordered(op: str):
    def how(a: Column, b: Column, tag: str) -> Column:
        if tag == "boolean":
            return F.lit(False)
        return {"gt": a > b, "gte": a >= b, "lt": a < b, "lte": a <= b}[op]

    return how


def _text(op: str):
    find = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op]
    return lambda a, b, tag: find(a, b) if tag == "string" else F.lit(False)


def condition(cell: Typed, f: dict, rule: dict) -> Column:
    """The filter over a cell as a condition of WHERE: true where it passes, false or null elsewhere.

    Comparisons of columns of one type are plain, so that they reach the scan."""
    op, column = f["operator"], f["column"]
    value = f["value"] if "value" in f else f.get("values")
    if op == "isNull":
        return cell.blank
    if op == "isNotNull":
        return ~cell.blank
    if op == "eq":
        return _equal(cell, value, rule, column)
    if op == "ne":
        return _none_of(cell, [value], rule, column)
    if op == "in":
        return _any_of(cell, value, rule, column)
    if op == "notIn":
        return _none_of(cell, value, rule, column)
    if op in ("gt", "gte", "lt", "lte"):
        return _compare(cell, value, rule, column, _ordered(op))
    if op == "between":
        return _compare(cell, value[0], rule, column, _ordered("gte")) & _compare(cell, value[1], rule, column, _ordered("lte"))
    if op in ("contains", "startsWith", "endsWith"):
        if isinstance(value, str) and cell.tag == "date":
            return _compare(cell, value, rule, column, lambda a, b, tag: F.lit(False))
        return _compare(cell, value, rule, column, _text(op))
    return F.lit(False)


def _any_of(cell: Typed, values: list, rule: dict, column: str) -> Column:
    """A plain OR, but a CASE in the values' order where one of them fails."""
    found = [_equal(cell, x, rule, column) for x in values]
    if fails(cell, {"operator": "in", "values": values}):
        out = F.lit(False)
        for x in found:
            out = F.when(true(out), True).otherwise(x)
        return out
    return functools.reduce(lambda a, b: a | b, found, F.lit(False))


def _none_of(cell: Typed, values: list, rule: dict, column: str) -> Column:
    tags = [literal(x, rule)[0] for x in values]
    if cell.tag in ("string", "number", "boolean") and "numericTolerance" not in rule:
        known = [constant(literal(x, rule)[1]) for x, t in zip(values, tags, strict=True) if t == cell.tag]
        differs = [cell.value != x for x in known]
        if "blank" in tags:
            return functools.reduce(lambda a, b: a & b, differs, ~cell.blank)
        return functools.reduce(lambda a, b: a & b, differs) | cell.blank if differs else F.lit(True)
    return ~true(_any_of(cell, values, rule, column))


def predicate(cell: Typed, f: dict, rule: dict) -> Column:
    """The filter over a cell: true or false, never null."""
    return true(condition(cell, f, rule))


def all_of(conditions: list[tuple[Column, bool]]) -> Column:
    """Conjunction from left to right of conditions, each with whether it can fail, as a condition of WHERE.

    Those that can't fail are plain ANDs, which reach the scan; one that can isn't evaluated where an earlier one
    isn't true."""
    out = None
    for i in reversed(range(len(conditions))):
        one, failing = conditions[i]
        if not failing:
            out = one if out is None else one & out
            continue
        rest = one if out is None else F.when(true(one), out).otherwise(False)
        earlier = [c for c, _ in conditions[:i]]
        out = F.when(true(functools.reduce(lambda a, b: a & b, earlier)), rest).otherwise(False) if earlier else rest
    return F.lit(True) if out is None else out
