"""N-way comparison of versions against a baseline: by key, by row position, or as multisets.

All versions are tagged, united and grouped by key in one exchange.  What is exchanged of a row is its key, its
number and 128 bits of hash of its compared values; counts and hashes classify a key, in a hash aggregation.  The
values are read again for the keys whose hashes differ, and only those are compared cell by cell.  Results are
DataFrames; nothing is collected.
"""

from __future__ import annotations

import functools
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DriftError, LimitError
from ..functions.cells import Typed, equal, normalise, tag_of, to_cell, unchecked
from ..functions.filters import all_of, condition, fails, true
from ..plans.mapping import resolve
from ..plans.spec import by_key, comparison_columns, rule_for
from ..sources.tables import ROW, Version

FILE, STATE, SIZE = "__file", "__state", "__bytes"
#: States of a scanned row: it takes part, its key has a blank, a filter leaves it out.
TAKEN, INVALID, LEFT_OUT = 0, 1, 2
#: Bytes of a row besides its cells, as limits count them.
ROW_BYTES = 150


class Scan(NamedTuple):
    """A version after mapping and normalisation: cells by column and the filters' condition, over the source."""

    id: str
    source: DataFrame
    cells: dict[str, Typed]
    keeps: Column

    @property
    def counted(self) -> bool:
        return "cell_count" in self.source.columns


class Result(NamedTuple):
    """Lazy results; those that a mode doesn't have are None.

    tally has one row for each key, and besides one for the invalid rows and one for those left out."""

    classified: DataFrame
    tally: DataFrame
    changed: DataFrame | None
    missing: DataFrame | None
    duplicates: DataFrame | None
    multiset: DataFrame | None
    counters: DataFrame
    aligned: DataFrame | None  # each key with the values of each version
    key: Column  # of tally and classified: the key as an array of cells


class Plan(NamedTuple):
    """What the steps of a comparison share."""

    ids: list[str]
    base: int
    keys: list[str]
    key_cells: list[Typed]
    cells: dict[str, Typed]  # of the compared columns
    rules: dict[str, dict]
    sheet: str


def value_name(i: int) -> str:
    return f"v{i}"


def prepare(version: Version, spec: dict, standard: list[str] | None) -> tuple[Scan, list[str]]:
    """Maps, normalises and filters a version."""
    columns, mapping = resolve(version.headers, spec, version.id, standard)
    types = {f.name: f.dataType for f in version.frame.schema.fields}
    cells: dict[str, Typed] = {}
    for name in columns:
        source = version.columns[mapping[name] - 1]
        cells[name] = normalise(F.col(f"`{source}`"), types[source], rule_for(spec, name))
    conditions = []
    for f in spec.get("filters", ()):
        source = version.columns[mapping[f["column"]] - 1]
        rule = rule_for(spec, f["column"])
        cell = unchecked(F.col(f"`{source}`"), types[source], rule)
        conditions.append((condition(cell, f, rule), fails(cell, f)))
    return Scan(version.id, version.frame, cells, all_of(conditions)), columns


def scans_of(versions: list[Version], spec: dict) -> tuple[list[Scan], list[str], dict[str, str]]:
    """Scans in spec order, their columns and tags; the baseline fixes the columns, a column's cells have one form in all."""
    base = next(v for v in versions if v.id == spec["baseline"])
    first, columns = prepare(base, spec, None)
    scans = [first if v is base else prepare(v, spec, columns)[0] for v in versions]
    types = [{f.name: f.dataType for f in s.source.select(*(s.cells[c].value.alias(value_name(i)) for i, c in enumerate(columns))).schema.fields} for s in scans]
    out: list[dict[str, Typed]] = [{} for _ in scans]
    for i, name in enumerate(columns):
        kinds, tags = {t[value_name(i)].simpleString() for t in types}, {s.cells[name].tag for s in scans}
        for s, cells in zip(scans, out, strict=True):
            cell = s.cells[name]
            if len(tags) > 1:
                cell = Typed(to_cell(cell), "cell")
            elif len(kinds) > 1:
                cell = Typed(cell.value.cast("double" if tags == {"number"} else "timestamp_ntz" if tags == {"date"} else types[0][value_name(i)]), cell.tag)
            cells[name] = cell
    scans = [s._replace(cells=cells) for s, cells in zip(scans, out, strict=True)]
    return scans, columns, {name: scans[0].cells[name].tag for name in columns}


def valid_key(spec: dict, columns: list[str], tags: dict[str, str]) -> Column:
    """Over the value columns: no key cell is blank."""
    if not by_key(spec):
        return F.lit(True)
    return functools.reduce(lambda a, b: a & b, [~Typed(F.col(value_name(columns.index(k))), tags[k]).blank for k in spec["mode"]["keyColumns"]])


def united(scans: list[Scan], spec: dict, columns: list[str], tags: dict[str, str]) -> DataFrame:
    """All rows that take part, with the number of their version in spec order; filters reach the scans."""
    parts = []
    for i, s in enumerate(scans):
        rows = s.source.where(s.keeps).select(F.lit(i).alias(FILE), ROW, *(s.cells[c].value.alias(value_name(j)) for j, c in enumerate(columns)))
        parts.append(rows.where(valid_key(spec, columns, tags)) if by_key(spec) else rows)
    return functools.reduce(DataFrame.unionByName, parts)


def flagged(scans: list[Scan], spec: dict, columns: list[str], tags: dict[str, str]) -> DataFrame:
    """All rows with their state; those that don't take part have null values, so they group into one row each."""
    parts = []
    for i, s in enumerate(scans):
        kept = true(s.keeps)
        rows = s.source.select(F.lit(i).alias(FILE), ROW, (F.col("cell_count") if s.counted else F.lit(len(columns))).cast("long").alias("cells"), kept.alias("__kept"), *(F.when(kept, s.cells[c].value).alias(value_name(j)) for j, c in enumerate(columns)))
        state = F.when(~F.col("__kept"), LEFT_OUT).when(valid_key(spec, columns, tags), TAKEN).otherwise(INVALID)
        rows = rows.withColumn(STATE, state)
        names = [value_name(j) for j in range(len(columns))]
        parts.append(rows.select(FILE, STATE, "cells", *(F.when(F.col(STATE) == TAKEN, F.col(x)).alias(x) for x in (ROW, *names))))
    return functools.reduce(DataFrame.unionByName, parts)


def scan_counters(scans: list[Scan], spec: dict, columns: list[str], tags: dict[str, str]) -> DataFrame:
    """file, total, matched, invalid, cells of each version: a scan of the filters' and the key's columns alone."""
    parts = []
    for s in scans:
        keys = spec["mode"]["keyColumns"] if by_key(spec) else []
        extra = ["cell_count"] if s.counted else []
        rows = s.source.select(F.lit(s.id).alias("file"), true(s.keeps).alias("p"), *extra, *(s.cells[k].value.alias(value_name(columns.index(k))) for k in keys))
        valid = valid_key(spec, columns, tags)
        cells = F.sum("cell_count") if s.counted else F.count("*") * len(columns)
        parts.append(rows.groupBy("file").agg(F.count("*").alias("total"), F.count_if(F.col("p") & valid).alias("matched"), F.count_if(F.col("p") & ~valid).alias("invalid"), F.coalesce(cells, F.lit(0)).cast("long").alias("cells")))
    return functools.reduce(DataFrame.unionByName, parts)


def compare(versions: list[Version], spec: dict) -> Result:
    """The comparison that the spec asks for, over versions in spec order."""
    scans, columns, tags = scans_of(versions, spec)
    ids = [v.id for v in versions]
    base = ids.index(spec["baseline"])
    compared = comparison_columns(spec, columns)
    typed = {name: Typed(F.col(value_name(i)), tags[name]) for i, name in enumerate(columns)}
    mode = spec["mode"].get("type", "key")
    if mode == "multiset":
        keys = [value_name(columns.index(c)) for c in compared]
        key_cells = [typed[c] for c in compared]
    elif mode == "row":
        keys, key_cells = [ROW], [Typed(F.col(ROW), "number")]
    else:
        keys = [value_name(columns.index(k)) for k in spec["mode"]["keyColumns"]]
        key_cells = [typed[k] for k in spec["mode"]["keyColumns"]]
    plan = Plan(ids, base, keys, key_cells, {} if mode == "multiset" else {c: typed[c] for c in compared}, {c: rule_for(spec, c) for c in compared}, versions[base].sheet)
    rows = united(scans, spec, columns, tags)
    sized = [typed[c] for c in columns] if "resources" in spec else None
    tally = grouped(flagged(scans, spec, columns, tags), plan, mode == "multiset", sized)
    counters = scan_counters(scans, spec, columns, tags)
    out = Result(grouped(rows, plan, mode == "multiset"), tally, None, None, None, None, counters, None, key_of(plan))
    return derived(out, rows, plan, mode == "multiset")


def derived(result: Result, rows: DataFrame, plan: Plan, multiset: bool) -> Result:
    """The details that follow from the classified keys."""
    if multiset:
        return result._replace(multiset=count_differences(result.classified, plan))
    return result._replace(
        changed=changed(result.classified, rows, plan),
        missing=missing(result.classified, plan),
        duplicates=duplicates(result.classified, plan),
        aligned=aligned(rows, plan),
    )


def fingerprint(plan: Plan) -> tuple[list[Column], list[str]]:
    """What the row hash covers, and the columns of numbers within a tolerance, which it leaves out.

    Spark's hash skips nulls, so what is null is hashed too."""
    parts: list[Column] = []
    near = []
    for name, cell in plan.cells.items():
        tolerant = "numericTolerance" in plan.rules[name]
        if cell.tag == "cell":
            fields = [x for x in ("type", "num", "str", "bool", "ts", "formula", "result", "target", "tooltip") if not (tolerant and x == "num")]
            parts += [cell.value[x] for x in fields] + [cell.value[x].isNull() for x in ("target", "tooltip")]
        else:
            parts.append(cell.value.isNull())
            if not (tolerant and cell.tag == "number"):
                parts.append(cell.value)
        if tolerant and cell.tag in ("cell", "number"):
            near.append(name)
    return parts, near


def grouped(rows: DataFrame, plan: Plan, multiset: bool, sized: list[Typed] | None = None) -> DataFrame:
    """One row for each key: counts n<i> and row numbers row<i> of each version, and the key's status.

    Precedence: duplicate, missing, then changed or identical against the baseline.  Buffers are numbers only, which
    keeps the aggregation a hash aggregation.  sized: the cells that count for the bytes of a key's rows."""
    n_files = range(len(plan.ids))
    parts, near = fingerprint(plan)
    has_state = STATE in rows.columns
    own: dict[str, Column] = {}
    if not multiset:
        own = {"__h0": F.xxhash64(F.lit(0), *parts), "__h1": F.xxhash64(F.lit(-1), *parts, F.lit(1))}
        own |= {f"__t{j}": plan.cells[c].part("number") for j, c in enumerate(near)}
    if sized is not None:
        # the JSON text of the cells, as a row's size
        own[SIZE] = F.length(F.to_json(F.struct(*(x.value.alias(f"c{j}") for j, x in enumerate(sized))))).cast("long") + ROW_BYTES
    if has_state:
        own = {k: F.when(F.col(STATE) == TAKEN, v) for k, v in own.items()}
    rows = rows.withColumns(own) if own else rows
    values = [k for k in own if k != SIZE]
    if plan.keys == [ROW] and not has_state:  # a number is there once in a version: adding up before the exchange only fills memory
        rows = rows.select(FILE, ROW, *values).repartition(ROW)

    def of(i: int, x: str) -> Column:
        return F.when(F.col(FILE) == i, F.col(x))

    totals = [F.count(of(i, FILE)).alias(f"n{i}") for i in n_files]
    if not multiset:
        totals += [F.max(of(i, x)).alias(f"{x}_{i}") for i in n_files for x in values]
        totals += [F.max(of(i, ROW)).alias(f"row{i}") for i in n_files]
    if sized is not None:
        totals.append(F.sum(SIZE).alias(SIZE))
    if has_state:
        totals.append(F.sum("cells").alias("cells"))
    groups = rows.groupBy(*([STATE] if has_state else []), *plan.keys).agg(*totals)
    n = [F.col(f"n{i}") for i in n_files]
    if multiset:
        same = functools.reduce(lambda a, b: a & b, [x == n[plan.base] for x in n])
        status = F.when(same, "identical").otherwise("changed")
    else:
        differs = [_differs(values, plan, near, i) for i in n_files if i != plan.base]
        duplicate = functools.reduce(lambda a, b: a | b, [x > 1 for x in n])
        absent = functools.reduce(lambda a, b: a | b, [x == 0 for x in n])
        status = F.when(duplicate, "duplicate").when(absent, "missing").when(functools.reduce(lambda a, b: a | b, differs), "changed").otherwise("identical")
    if has_state:
        status = F.when(F.col(STATE) == TAKEN, status)
    return groups.withColumn("status", status).drop(*(f"{x}_{i}" for i in n_files for x in values))


def _differs(values: list[str], plan: Plan, near: list[str], i: int) -> Column:
    """Whether version i's row differs from the baseline's, where both have one."""
    out = F.lit(False)
    for x in values:
        a, b = F.col(f"{x}_{plan.base}"), F.col(f"{x}_{i}")
        if x.startswith("__t"):  # which of them are numbers is in the hashes
            tolerance = plan.rules[near[int(x[3:])]]["numericTolerance"]
            out |= F.coalesce(F.abs(a - b) > F.lit(float(tolerance)), F.lit(False))
        else:
            out |= a != b
    return out


def aligned(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row for each key: counts n<i>, the row f<i> of each version with its cells, and differ_<j> of each column."""
    picked = F.struct(F.col(ROW).alias("row"), *(c.value.alias(f"c{j}") for j, c in enumerate(plan.cells.values())))
    counts = [F.count_if(F.col(FILE) == i).alias(f"n{i}") for i in range(len(plan.ids))]
    firsts = [F.first(F.when(F.col(FILE) == i, picked), ignorenulls=True).alias(f"f{i}") for i in range(len(plan.ids))]
    groups = rows.groupBy(*plan.keys).agg(*counts, *firsts)
    differs = []
    for j, (c, cell) in enumerate(plan.cells.items()):
        others = [~equal(Typed(F.col(f"f{plan.base}")[f"c{j}"], cell.tag), Typed(F.col(f"f{i}")[f"c{j}"], cell.tag), plan.rules[c]) for i in range(len(plan.ids)) if i != plan.base]
        differs.append(functools.reduce(lambda a, b: a | b, others).alias(f"differ_{j}"))
    return groups.select("*", *differs)


def key_of(plan: Plan) -> Column:
    return F.array(*(to_cell(k) for k in plan.key_cells)).alias("key")


def changed(classified: DataFrame, rows: DataFrame, plan: Plan) -> DataFrame:
    """key, sheet, column, place of the column, and for each version a struct of value and row.

    The values are those of the keys whose hashes differ; what the other keys hold isn't exchanged."""
    wanted = classified.where("status = 'changed'").select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(plan.keys)))
    on = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(plan.keys)])
    found = aligned(rows.join(wanted, on), plan)  # keys are there once; a semi join would go into every version's scan
    entries = []
    for j, (name, cell) in enumerate(plan.cells.items()):
        files = [F.struct(to_cell(Typed(F.col(f"f{i}")[f"c{j}"], cell.tag)).alias("value"), F.col(f"f{i}")["row"].alias("row")).alias(f"file{i}") for i in range(len(plan.ids))]
        entries.append(F.when(F.col(f"differ_{j}"), F.struct(F.lit(name).alias("column"), F.lit(j).alias("place"), *files)))
    if not entries:
        found, entries = found.where("false"), [F.struct(F.lit("").alias("column"), F.lit(0).alias("place"))]
    exploded = found.select(key_of(plan), F.lit(plan.sheet).alias("sheet"), F.explode(F.array_compact(F.array(*entries))).alias("x"))
    return exploded.select("key", "sheet", "x.*")


def present(ids: list[str], there: bool) -> Column:
    return F.array_compact(F.array(*(F.when((F.col(f"n{i}") > 0) == there, F.lit(x)) for i, x in enumerate(ids))))


def missing(classified: DataFrame, plan: Plan) -> DataFrame:
    relation = F.when(F.col(f"n{plan.base}") > 0, "DELETED").otherwise("ADDED")
    return classified.where("status = 'missing'").select(key_of(plan), F.lit(plan.sheet).alias("sheet"), present(plan.ids, True).alias("presentFiles"), present(plan.ids, False).alias("missingFiles"), relation.alias("baselineRelation"))


def duplicates(classified: DataFrame, plan: Plan) -> DataFrame:
    files = F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 1, F.lit(x)) for i, x in enumerate(plan.ids))))
    return classified.where("status = 'duplicate'").select(key_of(plan), files.alias("files"))


def count_differences(groups: DataFrame, plan: Plan) -> DataFrame:
    """Combinations of values whose counts differ between the versions."""
    relation = F.when(F.col(f"n{plan.base}") == 0, "ADDED").otherwise("DELETED")
    return groups.where("status = 'changed'").select(key_of(plan).alias("values"), F.lit(plan.sheet).alias("sheet"), *(F.col(f"n{i}").alias(f"count{i}") for i in range(len(plan.ids))), relation.alias("baselineRelation"))


def summed(result: Result) -> DataFrame:
    """One row: rows scanned, matched and invalid, cells, and keys by status; all from one pass over the versions."""
    files = [x for x in result.tally.columns if x[0] == "n" and x[1:].isdigit()]
    rows = functools.reduce(lambda a, b: a + b, [F.col(x) for x in files])
    keys = [F.count_if((F.col(STATE) == TAKEN) & (F.col("status") == s)).alias(f"{s}_keys") for s in ("identical", "changed", "missing", "duplicate")]

    def total(state: int | None) -> Column:
        return F.coalesce(F.sum(rows if state is None else F.when(F.col(STATE) == state, rows)), F.lit(0))

    return result.tally.agg(total(None).alias("total_rows"), total(TAKEN).alias("matched_rows"), total(INVALID).alias("invalid_rows"), F.coalesce(F.sum("cells"), F.lit(0)).alias("cells"), *keys)


def summary(result: Result, n_files: int) -> dict:
    """The eight counters of a comparison."""
    row = summed(result).first()
    return {
        "files": n_files,
        "totalRowsScanned": row["total_rows"],
        "matchedRows": row["matched_rows"],
        "identicalKeys": row["identical_keys"],
        "changedKeys": row["changed_keys"],
        "missingKeys": row["missing_keys"],
        "duplicateKeys": row["duplicate_keys"],
        "invalidRows": row["invalid_rows"],
    }


def within(limits: dict, rows: int, cells: int) -> None:
    """Limits on scanned rows and cells."""
    for code, name, value in (("ROW_LIMIT_EXCEEDED", "maxRows", rows), ("CELL_LIMIT_EXCEEDED", "maxCells", cells)):
        if name in limits and value > limits[name]:
            raise LimitError(code, f"comparison exceeds resources.{name}")


def enforce(result: Result, spec: dict) -> None:
    """Limits on scanned rows and cells and on the bytes of one key's rows, and the policy that forbids duplicate keys."""
    limits = spec.get("resources") or {}
    if "maxRows" in limits or "maxCells" in limits:
        row = summed(result).first()
        within(limits, row["total_rows"], row["cells"])
    if "maxPartitionBytes" in limits and SIZE in result.tally.columns:
        largest = result.tally.where(F.col(STATE) == TAKEN).agg(F.max(SIZE)).first()[0] or 0
        if largest > limits["maxPartitionBytes"]:
            raise LimitError("HOT_KEY_TOO_LARGE", "single key exceeds resources.maxPartitionBytes")
    if spec.get("duplicateKeyPolicy") == "fail" and result.duplicates is not None:
        first = result.duplicates.limit(1).collect()
        if first:
            raise DriftError("DUPLICATE_KEY", f"duplicate business key in files {', '.join(first[0]['files'])}")


def frames(spark: SparkSession, tables: dict[str, DataFrame], spec: dict, **how) -> Result:
    """Compares DataFrames by id, in the dict's order."""
    from ..sources.tables import from_frame

    full = {"compareColumns": "*", "filters": [], "columnAliases": {}, "normalization": {"columns": {}}, "duplicateKeyPolicy": "report"} | spec
    return compare([from_frame(i, df, **how) for i, df in tables.items()], full)
