"""Profiles of versions: types, blanks, key candidates, risks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import Typed, normalise
from ..plans.mapping import nfkc
from ..plans.spec import DEFAULT_RULE
from ..sources.tables import ROW, Version

TAGS = ("blank", "boolean", "date", "error", "formula", "hyperlink", "number", "string")


def cells(version: Version) -> list[tuple[int, str, Typed]]:
    """Place, header and cell of each column with a header."""
    types = {f.name: f.dataType for f in version.frame.schema.fields}
    return [(i, h, normalise(F.col(f"`{c}`"), types[c], DEFAULT_RULE)) for i, (h, c) in enumerate(zip(version.headers, version.columns, strict=True), 1) if h]


def profile(version: Version, sample_rows: int = 10_000, full_types: bool = False, header_row: int = 1) -> DataFrame:
    """One row for each column: place, header, a count for each type, blank and distinct counts of the sample.

    The sample is the first rows by row number; with full_types, types are counted over all rows."""
    found = cells(version)
    sampled = F.col(ROW) <= header_row + sample_rows
    frame = version.frame if full_types else version.frame.where(sampled)
    # one pass for all columns: a row for each column, grouped by its place
    entries = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(h).alias("header"), x.type.alias("type"), F.xxhash64(F.struct(x.value)).alias("h1"), F.sha2(F.to_json(F.struct(x.type, x.value)), 256).alias("h2")) for i, h, x in found))
    rows = frame.select(sampled.alias("sampled"), F.explode(entries).alias("x")).select("sampled", "x.*")
    counts = [F.count_if(F.col("type") == t).alias(f"n_{t}") for t in TAGS]
    return rows.groupBy("place", "header").agg(
        F.count("*").alias("typed_rows"),
        *counts,
        F.count_if("sampled").alias("sampled_rows"),
        F.count_if(F.col("sampled") & (F.col("type") == "blank")).alias("sample_blanks"),
        F.count_distinct(F.when(F.col("sampled"), F.struct("type", "h2"))).alias("sample_distinct"),
    )


def key_candidates(profiled: DataFrame) -> DataFrame:
    """Columns whose sample has neither blanks nor repeated values, and whose header is unique."""
    return profiled.where("sampled_rows > 0 AND sample_blanks = 0 AND sample_distinct = sampled_rows")


def describe(version: Version, sheets: list[dict], merges: int, formulas: int, file: str, header_row: int, sample_rows: int, full_types: bool) -> dict:
    """The value-free profile of one file."""
    rows = {r["place"]: r for r in profile(version, sample_rows, full_types, header_row).collect()}
    headers = [(i, h) for i, h in enumerate(version.headers, 1) if h]
    groups: dict[str, list] = {}
    for i, h in headers:
        groups.setdefault(nfkc(h), []).append({"index": i, "raw": h})
    risks: list[dict] = [{"code": "HEADER_DUPLICATED", "normalized": k, "columns": v} for k, v in groups.items() if len(v) > 1]
    twice = {r["normalized"] for r in risks}
    if formulas:
        risks.append({"code": "FORMULA_CELLS", "count": formulas})
    if merges:
        risks.append({"code": "MERGED_CELLS", "count": merges})
    sampled = max((r["sampled_rows"] for r in rows.values()), default=0)
    out, candidates = [], []
    for i, h in headers:
        r = rows.get(i)
        types = {t: r[f"n_{t}"] for t in TAGS if r[f"n_{t}"]} if r else {}
        out.append({"index": i, "raw": h, "normalized": nfkc(h), "types": types, "emptyRatio": r["n_blank"] / r["typed_rows"] if r else 0})
        if r and nfkc(h) not in twice and r["sampled_rows"] and not r["sample_blanks"] and r["sample_distinct"] == r["sampled_rows"]:
            candidates.append({"columns": [nfkc(h)], "duplicateRate": 0, "sampledRows": r["sampled_rows"]})
    target = next(s for s in sheets if s["name"] == version.sheet)
    return {"file": file, "sheets": sheets, "sheet": target | {"headerRow": header_row}, "sampledRows": sampled, "headers": out, "keyCandidates": candidates, "risks": risks}
