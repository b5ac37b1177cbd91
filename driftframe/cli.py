"""Command line: compare --spec PATH [--progress] [--keep-temp] | inspect --files A B [...] --sheet NAME [--full-types]."""

from __future__ import annotations

import os
import sys
import traceback

from .errors import UsageError, failure
from .functions.cells import js_json

#: The usage lines and option names of the command line.
COMPARE = "usage: driftframe compare --spec <path> [--progress] [--keep-temp]"
INSPECT = "usage: driftframe inspect --files <a.xlsx> <b.xlsx> [more.xlsx...] --sheet <name> [--full-types]"


def parse(args: list[str]) -> dict:
    """Options of a command; each may be given once."""
    if args[:1] == ["compare"]:
        usage, flags, valued = COMPARE, {"--progress", "--keep-temp"}, {"--spec": 1}
    elif args[:1] == ["inspect"]:
        usage, flags, valued = INSPECT, {"--full-types"}, {"--files": 2, "--sheet": 1}
    else:
        raise UsageError(f"{COMPARE}; {INSPECT}")
    out: dict = {"command": args[0]}
    rest = args[1:]
    while rest:
        name = rest.pop(0)
        if name in out or name not in flags | set(valued):
            raise UsageError(usage)
        if name in flags:
            out[name] = True
            continue
        values = []
        while rest and not rest[0].startswith("--") and (valued[name] > 1 or not values):
            values.append(rest.pop(0))
        if len(values) < valued[name] or not all(values):
            raise UsageError(usage)
        out[name] = values
    if set(valued) - set(out):
        raise UsageError(usage)
    return out


def main(args: list[str], spark=None, out=None, err=None) -> int:
    """Runs a command; writes one JSON line and returns the exit code."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        options = parse(args)
        from pyspark.sql import SparkSession

        from .plans import run
        from .streaming.progress import Progress

        spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if options["command"] == "inspect":
            result = run.inspect_files(spark, options["--files"], options["--sheet"][0], full_types="--full-types" in options)
            needs = [{"file": f["file"], "sheet": f["sheet"]["name"], "duplicates": twice} for f in result["files"] if (twice := [{"normalized": r["normalized"], "columns": r["columns"]} for r in f["risks"] if r["code"] == "HEADER_DUPLICATED"])]
            out.write(js_json({"status": "NEEDS_INPUT", "code": "HEADER_DUPLICATED", "files": needs} if needs else result) + "\n")
            return 3 if needs else 0
        progress = Progress(err) if "--progress" in options else None
        published = run.compare_path(spark, options["--spec"][0], progress, "--keep-temp" in options)
        out.write(js_json(published) + "\n")
        return 0
    except Exception as e:
        code, said = failure(e)
        if getattr(e, "temp_directory", None):
            said["tempDirectory"] = e.temp_directory
        if os.environ.get("DRIFTFRAME_DEBUG") == "1":
            said["stack"] = traceback.format_exc()
        err.write(js_json(said) + "\n")
        return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
