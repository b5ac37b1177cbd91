"""The comparison spec: a JSON document, checked and given its defaults on the driver."""

from __future__ import annotations

import json
import os

from ..errors import SpecError

#: Fixed values, as all field names of a spec below: the filter operators and the defaults of the resource limits.
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "in", "notIn", "contains", "startsWith", "endsWith", "isNull", "isNotNull", "between")
RESOURCES = {
    "maxFiles": 16,
    "maxInputBytes": 10737418240,
    "maxRows": 10000000,
    "maxCells": 500000000,
    "maxTempBytes": 53687091200,
    "maxPartitionBytes": 67108864,
    "maxRuntimeMs": 86400000,
}
FORMULA_MODES = ("formula", "cached-result", "formula-and-cached-result")
DEFAULT_RULE = {"emptyEqualsNull": False, "caseSensitive": True, "formulaMode": "formula-and-cached-result"}


class Checker:
    """Collects what is wrong with a document, by path."""

    def __init__(self):
        self.errors: list[str] = []

    def fail(self, path: str, what: str) -> None:
        self.errors.append(f"{path or '/'} {what}")

    def obj(self, value, path: str, required=(), optional=()) -> bool:
        if not isinstance(value, dict):
            self.fail(path, "must be object")
            return False
        for name in required:
            if name not in value:
                self.fail(path, f"must have required property '{name}'")
        for name in value:
            if name not in required and name not in optional:
                self.fail(path, "must NOT have additional properties")
        return True

    def text(self, value, path: str) -> bool:
        if not isinstance(value, str) or not value:
            self.fail(path, "must be a non-empty string")
            return False
        return True

    def names(self, value, path: str) -> bool:
        if not isinstance(value, list) or not value:
            self.fail(path, "must be a non-empty array")
            return False
        good = all([self.text(x, f"{path}/{i}") for i, x in enumerate(value)])
        if good and len(set(value)) < len(value):
            self.fail(path, "must NOT have duplicate items")
        return good

    def one_of(self, value, path: str, allowed) -> None:
        if not any(value == x and isinstance(value, type(x)) for x in allowed):
            self.fail(path, "must be equal to one of the allowed values")

    def flag(self, value, path: str) -> None:
        if not isinstance(value, bool):
            self.fail(path, "must be boolean")

    def whole(self, value, path: str, least: int) -> None:
        if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value) or value < least:
            self.fail(path, f"must be integer >= {least}")


def is_scalar(value) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def check_shape(spec) -> None:
    """Raises SpecError unless the document has the form of a spec; fills in defaults."""
    k = Checker()
    required = ("version", "baseline", "files", "sheet", "mode", "compareColumns", "duplicateKeyPolicy", "output")
    if not k.obj(spec, "", required, ("columnAliases", "filters", "normalization", "resources")):
        raise SpecError("; ".join(k.errors))
    get = spec.get
    if "version" in spec:
        k.one_of(get("version"), "/version", ("1.0",))
    if "baseline" in spec:
        k.text(get("baseline"), "/baseline")
    if "files" in spec:
        files = get("files")
        if not isinstance(files, list) or len(files) < 2:
            k.fail("/files", "must have at least 2 items")
        else:
            for i, x in enumerate(files):
                if k.obj(x, f"/files/{i}", ("id", "path")):
                    for name in ("id", "path"):
                        if name in x:
                            k.text(x[name], f"/files/{i}/{name}")
    if "sheet" in spec and k.obj(get("sheet"), "/sheet", ("name", "headerRow")):
        if "name" in get("sheet"):
            k.text(get("sheet")["name"], "/sheet/name")
        if "headerRow" in get("sheet"):
            k.whole(get("sheet")["headerRow"], "/sheet/headerRow", 1)
    if "mode" in spec:
        mode = get("mode")
        kind = mode.get("type") if isinstance(mode, dict) else None
        if kind == "key":
            k.obj(mode, "/mode", ("type", "keyColumns"))
            if "keyColumns" in mode:
                k.names(mode["keyColumns"], "/mode/keyColumns")
        elif kind in ("row", "multiset"):
            k.obj(mode, "/mode", ("type",))
        else:
            k.fail("/mode", "must match exactly one schema in oneOf")
    if "compareColumns" in spec and get("compareColumns") != "*":
        k.names(get("compareColumns"), "/compareColumns")
    aliases = spec.setdefault("columnAliases", {})
    if k.obj(aliases, "/columnAliases", (), tuple(aliases) if isinstance(aliases, dict) else ()):
        for name, values in aliases.items():
            k.text(name, "/columnAliases")
            k.names(values, f"/columnAliases/{name}")
    filters = spec.setdefault("filters", [])
    if not isinstance(filters, list):
        k.fail("/filters", "must be array")
    else:
        for i, f in enumerate(filters):
            at = f"/filters/{i}"
            if k.obj(f, at, ("column", "operator"), ("value", "values")):
                if "column" in f:
                    k.text(f["column"], f"{at}/column")
                if "operator" in f:
                    k.one_of(f["operator"], f"{at}/operator", OPERATORS)
                if "value" in f and not is_scalar(f["value"]) and not (isinstance(f["value"], list) and all(map(is_scalar, f["value"]))):
                    k.fail(f"{at}/value", "must be a scalar or an array of scalars")
                if "values" in f and not (isinstance(f["values"], list) and all(map(is_scalar, f["values"]))):
                    k.fail(f"{at}/values", "must be an array of scalars")
    rules = spec.setdefault("normalization", {"columns": {}})
    if k.obj(rules, "/normalization", (), ("emptyEqualsNull", "caseSensitive", "formulaMode", "columns")):
        for name in ("emptyEqualsNull", "caseSensitive"):
            k.flag(rules.setdefault(name, DEFAULT_RULE[name]), f"/normalization/{name}")
        k.one_of(rules.setdefault("formulaMode", FORMULA_MODES[2]), "/normalization/formulaMode", FORMULA_MODES)
        columns = rules.setdefault("columns", {})
        if k.obj(columns, "/normalization/columns", (), tuple(columns) if isinstance(columns, dict) else ()):
            for name, rule in columns.items():
                at = f"/normalization/columns/{name}"
                k.text(name, "/normalization/columns")
                if k.obj(rule, at, (), ("trim", "caseSensitive", "emptyEqualsNull", "numericTolerance")):
                    for flag in ("trim", "caseSensitive", "emptyEqualsNull"):
                        if flag in rule:
                            k.flag(rule[flag], f"{at}/{flag}")
                    tolerance = rule.get("numericTolerance", 0)
                    if isinstance(tolerance, bool) or not isinstance(tolerance, (int, float)) or not tolerance >= 0:
                        k.fail(f"{at}/numericTolerance", "must be number >= 0")
    if "duplicateKeyPolicy" in spec:
        k.one_of(get("duplicateKeyPolicy"), "/duplicateKeyPolicy", ("report", "fail"))
    resources = spec.setdefault("resources", {})
    if k.obj(resources, "/resources", (), tuple(RESOURCES)):
        for name, value in RESOURCES.items():
            k.whole(resources.setdefault(name, value), f"/resources/{name}", 1)
    if "output" in spec and k.obj(get("output"), "/output", ("directory",), ("sampleSize",)):
        if "directory" in get("output"):
            k.text(get("output")["directory"], "/output/directory")
        k.whole(get("output").setdefault("sampleSize", 20), "/output/sampleSize", 0)
    if k.errors:
        raise SpecError("; ".join(k.errors))


#: operator -> (needs an array, how many operands or None)
ARITY = {"isNull": None, "isNotNull": None, "in": (True, 0), "notIn": (True, 0), "between": (True, 2)}


def check_operands(filters: list[dict]) -> None:
    """Each operator takes its own kind of operand."""
    for i, f in enumerate(filters):
        op, single, several = f["operator"], "value" in f, "values" in f
        where = f"filters/{i}: {op}"
        wants = ARITY.get(op, (False, 1))
        if wants is None:
            if single or several:
                raise SpecError(f"{where} must not include value or values")
        elif wants[0]:
            if single == several:
                raise SpecError(f"{where} requires exactly one of value or values")
            values = f["value"] if single else f["values"]
            if wants[1] and (not isinstance(values, list) or len(values) != wants[1]):
                raise SpecError(f"{where} requires exactly two values")
            if not isinstance(values, list) or not values:
                raise SpecError(f"{where} requires at least one value")
        elif several:
            raise SpecError(f"{where} must not include values")
        elif not single:
            raise SpecError(f"{where} requires value")
        elif isinstance(f["value"], list):
            raise SpecError(f"{where} requires a scalar value")


def check_spec(spec: dict, directory: str = ".") -> dict:
    """A checked copy with defaults and absolute paths."""
    spec = json.loads(json.dumps(spec))
    check_shape(spec)
    if len(spec["files"]) > spec["resources"]["maxFiles"]:
        raise SpecError("file count exceeds resources.maxFiles")
    ids, paths = set(), set()
    for f in spec["files"]:
        if f["id"] in ids:
            raise SpecError(f"duplicate file ID: {f['id']}")
        ids.add(f["id"])
        f["path"] = os.path.abspath(os.path.join(directory, f["path"]))
        if f["path"] in paths:
            raise SpecError(f"duplicate input path: {f['path']}")
        paths.add(f["path"])
        if os.path.splitext(f["path"])[1].lower() != ".xlsx":
            raise SpecError(f"input file must use .xlsx: {f['path']}")
    if spec["baseline"] not in ids:
        raise SpecError(f"baseline does not reference a file ID: {spec['baseline']}")
    out = spec["output"]
    out["directory"] = os.path.abspath(os.path.join(directory, out["directory"]))
    if out["directory"] in paths:
        raise SpecError(f"output directory must not equal an input file: {out['directory']}")
    check_operands(spec["filters"])
    return spec


def load_spec(path: str) -> dict:
    path = os.path.abspath(path)
    try:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
    except (OSError, ValueError) as e:
        raise SpecError(f"cannot read or parse spec: {e}") from e
    return check_spec(raw, os.path.dirname(path))


def rule_for(spec: dict, column: str) -> dict:
    """Defaults, then the rules of all columns, then the column's own."""
    rules = spec.get("normalization") or {}
    return DEFAULT_RULE | {k: v for k, v in rules.items() if k != "columns"} | rules.get("columns", {}).get(column, {})


def by_key(spec: dict) -> bool:
    return spec["mode"].get("type", "key") not in ("row", "multiset")


def required_columns(spec: dict) -> list[str]:
    """Key columns, named compare columns and filter columns, each once, in this order."""
    names = list(spec["mode"]["keyColumns"]) if by_key(spec) else []
    if spec["compareColumns"] != "*":
        names += spec["compareColumns"]
    return list(dict.fromkeys(names + [f["column"] for f in spec.get("filters", ())]))


def comparison_columns(spec: dict, columns: list[str]) -> list[str]:
    chosen = columns if spec["compareColumns"] == "*" else spec["compareColumns"]
    keys = set(spec["mode"]["keyColumns"]) if by_key(spec) else set()
    return [x for x in chosen if x not in keys]
