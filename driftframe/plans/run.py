"""Whole runs: compare by a spec, inspect by paths."""

from __future__ import annotations

import hashlib
import os
import threading
import time
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DriftError, InputError, LimitError, tagged
from ..operators import diff, profile
from ..sinks import report
from ..sinks.report import encoded
from ..sources import store, xlsx
from ..sources.tables import Version
from ..streaming.progress import Progress
from .mapping import resolve
from .spec import load_spec


def input_bytes(files: list[dict]) -> int:
    total = 0
    for f in files:
        if not os.path.isfile(f["path"]) or not os.access(f["path"], os.R_OK):
            raise InputError("INPUT_ERROR", f"cannot read XLSX input for {f['id']}")
        total += os.path.getsize(f["path"])
    return total


class Deadline:
    """Ends a run once its time is over: check() raises, and the run's own jobs are cancelled, by their tag.

    Jobs of others in the same session go on.  The timer strikes again each second, as a job may begin after it."""

    def __init__(self, spark: SparkSession, milliseconds: float, clock=time.monotonic):
        self.context, self.clock = spark.sparkContext, clock
        self.seconds = milliseconds / 1000
        self.tag = f"driftframe-{uuid.uuid4().hex}"
        self.ended, self.late = threading.Event(), False

    def _watch(self) -> None:
        wait = self.seconds
        while not self.ended.wait(min(wait, threading.TIMEOUT_MAX)):
            self.late = True
            self.context.cancelJobsWithTag(self.tag)
            wait = 1.0

    @property
    def over(self) -> bool:
        return self.late or self.clock() - self.began > self.seconds

    def check(self) -> None:
        if self.over:
            raise LimitError("RUNTIME_LIMIT_EXCEEDED", "comparison exceeds resources.maxRuntimeMs")

    def __enter__(self):
        self.began = self.clock()
        self.context.addJobTag(self.tag)
        threading.Thread(target=self._watch, daemon=True).start()
        return self

    def __exit__(self, kind, error, trace):
        self.ended.set()
        self.context.removeJobTag(self.tag)
        if isinstance(error, Exception) and not isinstance(error, LimitError) and "cancel" in str(error).lower():
            self.check()


def stored(spark: SparkSession, spec: dict, deadline: Deadline, folder: str, progress: Progress | None) -> list[Version]:
    """Parses each workbook once, the baseline first, into a table of the shared folder; limits are checked after each."""
    limits = spec["resources"]
    out: dict[str, Version] = {}
    rows = cells = size = 0
    for f in sorted(spec["files"], key=lambda f: f["id"] != spec["baseline"]):
        deadline.check()
        version = xlsx.version(spark, f["id"], f["path"], spec["sheet"]["name"], spec["sheet"]["headerRow"])
        if not out:
            resolve(version.headers, spec, version.id, None)  # the baseline's mapping errors come first
        table = store.written(version.frame, f"{folder}/scan")
        deadline.check()
        seen = table.agg(F.count("*"), F.coalesce(F.sum("cell_count"), F.lit(0))).first()
        rows, cells, size = rows + seen[0], cells + seen[1], size + store.bytes_of(table)
        if progress:
            progress.scanned(f["id"], seen[0], size)
        diff.within(limits, rows, cells)
        if size > limits["maxTempBytes"]:
            raise LimitError("TEMP_LIMIT_EXCEEDED", "temporary data exceeds resources.maxTempBytes")
        out[f["id"]] = version._replace(frame=table)
    return [out[f["id"]] for f in spec["files"]]


def hash_first(result: diff.Result, limit: int):
    """Bytes that put keys in the order of their hashes: the first byte, and the whole hash in a part beyond the limit."""
    tally = result.tally.where(F.col(diff.STATE) == diff.TAKEN)
    wide: set[int] = set()
    if (tally.agg(F.sum(diff.SIZE)).first()[0] or 0) > limit:

        @F.pandas_udf("int")
        def part(keys: pd.Series) -> pd.Series:
            return pd.Series([hashlib.sha256(encoded(report._rows(k)).encode("utf-8", "surrogatepass")).digest()[0] for k in keys])

        sizes = tally.withColumn("__key", result.key).groupBy(part(report.as_json("__key")).alias("part")).agg(F.sum(diff.SIZE).alias("n"))
        wide = {r["part"] for r in sizes.where(F.col("n") > limit).collect()}  # 256 parts at most

    def first(text: str) -> bytes:
        code = hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()
        return code if code[0] in wide else code[:1]

    return first


def compare_with(spark: SparkSession, spec: dict, sink, progress: Progress | None = None, keep_temp: bool = False, clock=time.monotonic, by_hash: bool = True) -> dict:
    """Reads the workbooks of a spec and compares them; details go to the sink.  Returns the summary.

    by_hash: keys come in the order of their hashes' first byte and then of their encodings (within a part that
    exceeds maxPartitionBytes, of their whole hashes); else by encoding alone.  The scanned tables are removed at
    the end unless keep_temp asks for them; then tempDirectory, in the summary or on the error, names their folder."""
    limits = spec["resources"]
    folder = f"compare-{uuid.uuid4().hex}"
    whole = f"{store.shared_folder(spark)}/{folder}"
    cached = None
    try:
        with Deadline(spark, limits["maxRuntimeMs"], clock) as deadline:
            if input_bytes(spec["files"]) > limits["maxInputBytes"]:
                raise LimitError("INPUT_LIMIT_EXCEEDED", "comparison exceeds resources.maxInputBytes")
            versions = stored(spark, spec, deadline, folder, progress)
            result = diff.compare(versions, spec)
            cached = result.tally.persist()
            result = result._replace(tally=cached)
            deadline.check()
            diff.enforce(result, spec)
            deadline.check()
            summary = diff.summary(result, len(versions))
            deadline.check()
            first = hash_first(result, limits["maxPartitionBytes"]) if by_hash else None
            report.emit(result, [f["id"] for f in spec["files"]], sink, deadline.check, first, by_place=by_hash)
            deadline.check()
            if progress:
                progress.finish(spec["baseline"])
            return summary | ({"tempDirectory": whole} if keep_temp else {})
    except Exception as e:
        known = e if isinstance(e, DriftError) else tagged(e)
        if keep_temp:
            try:
                (known or e).temp_directory = whole
            except AttributeError:
                pass
        if known is None or known is e:
            raise
        raise known from None
    finally:
        if cached is not None:
            cached.unpersist()
        if keep_temp:
            store.keep(whole)
        else:
            store.remove(spark, whole)
            store.keep(whole)


def compare_spec(spark: SparkSession, spec: dict, progress: Progress | None = None, keep_temp: bool = False, clock=time.monotonic) -> dict:
    """Compares the workbooks of a spec and writes the report; a failure publishes a FAILED summary.  Returns the summary."""
    writer = report.ReportWriter(spec["output"]["directory"], [f["id"] for f in spec["files"]], spec["mode"].get("type", "key"))
    try:
        summary = compare_with(spark, spec, writer, progress, keep_temp, clock, by_hash=False)
        kept = {k: summary.pop(k) for k in list(summary) if k == "tempDirectory"}
        return writer.complete(summary) | kept
    except BaseException as e:
        writer.abort(e)
        raise


def compare_path(spark: SparkSession, path: str, progress: Progress | None = None, keep_temp: bool = False) -> dict:
    return compare_spec(spark, load_spec(path), progress, keep_temp)


def resolve_files(paths: list[str]) -> list[str]:
    if len(paths) < 2:
        raise InputError("INPUT_ERROR", "at least two XLSX inputs are required")
    out: list[str] = []
    for path in paths:
        if os.path.splitext(path)[1].lower() != ".xlsx":
            raise InputError("INPUT_ERROR", f"input file must use .xlsx: {path}")
        real = os.path.realpath(path)
        if not os.path.isfile(real) or not os.access(real, os.R_OK):
            raise InputError("INPUT_ERROR", f"cannot read XLSX input: {os.path.abspath(path)}")
        if real in out:
            raise InputError("INPUT_ERROR", f"duplicate input path: {real}")
        out.append(real)
    return out


def inspect_files(spark: SparkSession, paths: list[str], sheet: str, header_row: int = 1, sample_rows: int = 10_000, full_types: bool = False) -> dict:
    """Value-free profiles of two workbooks or more."""
    if not isinstance(sheet, str) or not sheet:
        raise InputError("INPUT_ERROR", "sheet is required")
    for name, value in (("headerRow", header_row), ("sampleRows", sample_rows)):
        if isinstance(value, bool) or not isinstance(value, int) or value < 1:
            raise InputError("INPUT_ERROR", f"{name} must be a positive integer")
    files = []
    for path in resolve_files(paths):
        try:
            sheets, merges, formulas = catalogue(spark, path, sheet)
            version = xlsx.version(spark, path, path, sheet, header_row)
            files.append(profile.describe(version, sheets, merges, formulas, path, header_row, sample_rows, full_types))
        except Exception as e:
            raise tagged(e) or e from None
    return {"status": "INSPECTED", "sampleRows": sample_rows, "fullTypes": full_types, "files": files}


def catalogue(spark: SparkSession, path: str, sheet: str) -> tuple[list[dict], int, int]:
    """Sheets with their visibility, merged ranges and formula cells of the sheet."""

    def run(batches):
        import json

        import pyarrow as pa

        for batch in batches:
            for data in batch.column(0).to_pylist():
                reader = xlsx._read(data, path, sheet)
                for _ in reader.rows():
                    pass
                out = {"sheets": [{"name": s.name, "visibility": s.visibility} for s in reader.book.sheets], "merges": reader.merges, "formulas": reader.formulas}
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(out)])], ["found"])

    import json

    frame: DataFrame = xlsx.binary(spark, path).mapInArrow(run, "found string")
    found = json.loads(frame.first()[0])
    return found["sheets"], found["merges"], found["formulas"]
