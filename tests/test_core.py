import hashlib
import io
import itertools
import json
import os
import random
import re
import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftframe.cli import main, parse
from driftframe.errors import DriftError, InputError, SpecError, UsageError
from driftframe.functions.cells import js_json, number_text, print_value
from driftframe.functions.filters import date_literal, literal
from driftframe.operators import diff
from driftframe.plans import mapping, run
from driftframe.plans.spec import check_operands, check_spec, rule_for
from driftframe.queries import orders_diff
from driftframe.sinks.report import Sink, csv_cell, display_key, safe_text, safe_value
from driftframe.sources import store, tables, xlsx
from driftframe.sources.tables import from_frame

from .workbooks import write

SF = "/root/testdata/sf0.001"


def spec(**more):
    return {"version": "1.0", "baseline": "A", "files": [{"id": "A", "path": "a.xlsx"}, {"id": "B", "path": "b.xlsx"}], "sheet": {"name": "data", "headerRow": 1}, "mode": {"type": "key", "keyColumns": ["id"]}, "compareColumns": "*", "duplicateKeyPolicy": "report", "output": {"directory": "out"}} | more


def test_spec_defaults_and_errors():
    s = check_spec(spec(), "/x")
    assert s["resources"]["maxFiles"] == 16 and s["output"] == {"directory": "/x/out", "sampleSize": 20} and s["files"][0]["path"] == "/x/a.xlsx"
    for bad in ({"baseline": "C"}, {"extra": 1}, {"mode": {"type": "key"}}, {"compareColumns": []}, {"files": [{"id": "A", "path": "a.csv"}, {"id": "B", "path": "b.xlsx"}]}, {"output": {"directory": "a.xlsx"}}, {"resources": {"maxRows": 0}}, {"normalization": {"columns": {"x": {"numericTolerance": -1}}}}):
        with pytest.raises(SpecError):
            check_spec(spec(**bad))
    assert rule_for({"normalization": {"caseSensitive": False, "columns": {"x": {"trim": True}}}}, "x")["trim"] is True


@pytest.mark.parametrize("f", [{"operator": "isNull", "value": 1}, {"operator": "in", "values": []}, {"operator": "between", "values": [1]}, {"operator": "eq"}, {"operator": "eq", "value": [1]}, {"operator": "eq", "values": [1]}, {"operator": "in", "value": [1], "values": [1]}])
def test_operands(f):
    with pytest.raises(SpecError):
        check_operands([f])


def test_mapping():
    h = mapping.headers_of(["id", None, "Ｎame", "Sal"])
    assert mapping.map_columns(h, ["id", "Name", "salary"], {"salary": ["Sal", "Pay"]}) == {"id": 1, "Name": 3, "salary": 4}
    with pytest.raises(InputError, match="duplicate header"):
        mapping.headers_of(["A", "Ａ"])
    with pytest.raises(InputError) as e:
        mapping.map_columns(mapping.headers_of(["x", "y"]), ["p", "q"], {"p": ["x", "y"], "q": ["x", "y"]})
    assert e.value.code == "COLUMN_MAPPING_AMBIGUOUS"
    assert mapping.map_columns(mapping.headers_of(["x", "y"]), ["p", "q"], {"p": ["x", "y"], "q": ["y"]}) == {"p": 1, "q": 2}


def test_text_forms():
    assert [number_text(x) for x in (1.0, -0.0, 0.1, 1e21, 1e20, 1e-7, 1.5e-6, 123456789012345680000.0, -2.5, 2e23)] == ["1", "0", "0.1", "1e+21", "100000000000000000000", "1e-7", "0.0000015", "123456789012345680000", "-2.5", "2e+23"]
    assert js_json([["string", "é"], ["number", 1.0], ["blank", None]]) == '[["string","é"],["number",1],["blank",null]]'
    assert print_value(["formula", ["A1", ["number", 2.0]]]) == '["A1",["number",2]]' and print_value(["blank", None]) == ""
    assert csv_cell('a"b') == '"a""b"' and safe_text("=1") == 'json:"=1"' and safe_value(-5) == 'json:"-5"' and safe_value(True) == "true"
    assert display_key([["string", "a"], ["number", 1.0]]) == '["a",1]'


def test_literals():
    assert str(date_literal("2026-01-02T00:00+08:00")) == "2026-01-01 16:00:00" and date_literal("2026-02-30") is None and date_literal("2026-01-02T10:00") is None
    assert literal(" Ab ", {"trim": True, "caseSensitive": False}) == ("string", "ab") and literal("", {"emptyEqualsNull": True}) == ("blank", None)


def compare_frames(spark, a, b, schema="id string, x string", **more):
    full = {"baseline": "A", "mode": {"type": "key", "keyColumns": ["id"]}} | more
    return diff.frames(spark, {"A": spark.createDataFrame(a, schema), "B": spark.createDataFrame(b, schema)}, full)


def test_key_diff_precedence(spark):
    r = compare_frames(spark, [("1", "a"), ("2", "b"), ("3", "c"), ("3", "c"), ("5", None), (None, "z")], [("1", "a"), ("2", "B"), ("4", "d"), ("5", "")])
    got = {row["v0"]: row["status"] for row in r.classified.collect()}
    assert got == {"1": "identical", "2": "changed", "3": "duplicate", "4": "missing", "5": "changed"}
    assert diff.summary(r, 2) == {"files": 2, "totalRowsScanned": 10, "matchedRows": 9, "identicalKeys": 1, "changedKeys": 2, "missingKeys": 1, "duplicateKeys": 1, "invalidRows": 1}
    assert r.missing.collect()[0]["baselineRelation"] == "ADDED"


def test_rules(spark):
    r = compare_frames(spark, [("1", "a "), ("2", "")], [("1", " A"), ("2", None)], normalization={"emptyEqualsNull": True, "columns": {"x": {"trim": True, "caseSensitive": False}}})
    assert r.changed.count() == 0
    r = compare_frames(spark, [("1", 1.0), ("2", 1.0)], [("1", 1.05), ("2", 1.2)], "id string, x double", normalization={"columns": {"x": {"numericTolerance": 0.1}}})
    assert [x["key"][0]["str"] for x in r.changed.collect()] == ["2"]


def test_multiset(spark):
    r = compare_frames(spark, [("1", "a"), ("1", "a"), ("2", "b")], [("1", "a"), ("2", "b"), ("3", "c"), ("3", "c")], mode={"type": "multiset"})
    got = {(x["values"][0]["str"]): (x["count0"], x["count1"], x["baselineRelation"]) for x in r.multiset.collect()}
    assert got == {"1": (2, 1, "DELETED"), "3": (0, 2, "ADDED")}


def test_duplicate_policy_is_value_free(spark):
    r = compare_frames(spark, [("secret", "a"), ("secret", "b")], [("x", "a")])
    with pytest.raises(DriftError) as e:
        diff.enforce(r, {"duplicateKeyPolicy": "fail"})
    assert e.value.code == "DUPLICATE_KEY" and "secret" not in str(e.value)


def test_xlsx_cells(tmp_path):
    rows = [["id", "d", "f", "g", "h"], ["1", '<c s="1"><v>45000.5</v></c>', '<c ><f t="shared" si="0" ref="C2:C3">A2+$B$1</f><v>3</v></c>', '<c t="e"><v>#N/A</v></c>', "see"], None, ["2", True, '<c ><f t="shared" si="0"/><v>4</v></c>', '<c t="s"><v>0</v></c>', -0.0]]
    rows[2], rows[3] = rows[3], None
    rows.append(["3"])
    path = write(tmp_path / "a.xlsx", rows, extra='<hyperlinks><hyperlink ref="E2" r:id="rId9" tooltip="t"/></hyperlinks><mergeCells><mergeCell ref="A1:B1"/></mergeCells>', rels='<Relationship Id="rId9" Target="http://x/" TargetMode="External"/>', strings=["<r><t>ri</t></r><r><t>ch</t></r>"], hidden=("two",))
    reader = xlsx.SheetReader(xlsx.Workbook(path), "data")
    got = list(xlsx.data_rows(reader, 1))
    assert got[0] == ("header", ["id", "d", "f", "g", "h"], None) and [x[0] for x in got[1:]] == [2, 3, 4, 5] and got[3][1:] == (0, {})
    two, three = got[1][2], got[2][2]
    assert str(two[2].value) == "2023-03-15 12:00:00" and two[3].formula == "A2+$B$1" and three[3].formula == "A3+$B$1" and three[4].value == "rich"
    assert two[5][:1] == ("hyperlink",) and two[5].target == "http://x/" and two[4].kind == "error" and three[2].value is True
    assert reader.merges == 1 and reader.formulas == 2 and reader.book.sheets[1].visibility == "hidden"
    with pytest.raises(LookupError):
        xlsx.SheetReader(xlsx.Workbook(path), "none")


def test_compare_and_inspect_from_the_command_line(spark, tmp_path):
    write(tmp_path / "a.xlsx", [["id", "name", "pay"], ["1", "ann", 10], ["2", "bob", 20], ["3", "cy", 30], ["4", "=x", 1]])
    write(tmp_path / "b.xlsx", [["id", "pay", "Name"], ["1", 10.0, "ann"], ["2", 21, "bob"], ["4", 1, "y,z"], ["5", 5, "eve"]])
    (tmp_path / "spec.json").write_text(json.dumps(spec(columnAliases={"name": ["Name"]})))
    out, err = io.StringIO(), io.StringIO()
    assert main(["compare", "--spec", str(tmp_path / "spec.json"), "--progress"], spark, out, err) == 0, err.getvalue()
    published = json.loads(out.getvalue())
    assert (published["changedKeys"], published["missingKeys"], published["identicalKeys"], published["totalRowsScanned"]) == (2, 2, 1, 8)
    files = sorted(os.listdir(published["directory"]))
    assert files == ["changed.csv", "duplicate-keys.csv", "missing.csv", "summary.json"]
    with open(os.path.join(published["directory"], "changed.csv"), encoding="utf-8") as f:
        assert f.read() == 'key,sheet,column,A.value,A.type,A.row,B.value,B.type,B.row\n2,data,pay,20,number,3,21,number,3\n4,data,name,"json:""=x""",string,5,"y,z",string,4\n'
    assert json.loads(err.getvalue().splitlines()[-1])["rowsScanned"] == 8
    out = io.StringIO()
    assert main(["inspect", "--files", str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), "--sheet", "data"], spark, out, err) == 0
    first = json.loads(out.getvalue())["files"][0]
    assert [c["columns"] for c in first["keyCandidates"]] == [["id"], ["name"], ["pay"]] and first["headers"][2]["types"] == {"number": 4}
    err = io.StringIO()
    assert main(["inspect", "--files", str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), "--sheet", "none"], spark, io.StringIO(), err) == 4
    assert json.loads(err.getvalue())["code"] == "SHEET_NOT_FOUND"


def test_safe_text_of_whole_documents(spark, tmp_path):
    texts = ["plain", 'a "quoted", text', "tab\tline\r\nend", "\x01\x1f\\ é日本", "x" * 50 + '"tail, of a long text"\n', "\tbegins with a tab", None, ""]
    rows = [(i, t) for n, t in enumerate(texts) for i in range(6 * n, 6 * n + 6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in rows:
        whole = None if t is None else ["=", "+", "-", "@", "json:", ""][i % 6] + t
        want[i] = whole if whole is None or whole[:1] not in list("=+-@\t") and whole[:5] != "json:" else "json:" + json.dumps(whole, ensure_ascii=False)
    assert dict(map(tuple, entry.queries()["csv_safe_text"](spark, str(tmp_path)).collect())) == want


def test_usage():
    assert parse(["compare", "--spec", "x"])["--spec"] == ["x"]
    for bad in ([], ["compare"], ["inspect", "--files", "a.xlsx", "--sheet", "s"], ["inspect", "--sheet", "s"], ["compare", "--spec", "x", "--spec", "y"]):
        with pytest.raises(UsageError):
            parse(bad)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["filter_between"](spark, SF).count() > 0


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbered_rows(spark, adaptive):
    """Every row of a large, wide and skewed table gets its own number, whatever the partitioning."""
    n = 3_000_000
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        frame = spark.range(0, n, 1, 9).select((F.lit(n - 1) - F.col("id")).alias("id"), *(F.concat(F.lit("x" * 20), F.col("id").cast("string")).alias(f"c{i}") for i in range(4)))
        got = from_frame("A", frame.where("id % 7 <> 3 or id > 100"), order_by=["id"]).frame
        small = from_frame("B", frame.where("id < 100"), order_by=["id"]).frame
        left_out = sum(i % 7 == 3 for i in range(101))
        row = got.where("id > 100").agg(F.count("*"), F.count_if(F.col("__row") != F.col("id") + 2 - left_out), F.max("__row"), F.count_if(F.col("c3").isNull())).first()
        assert tuple(row) == (n - 101, 0, n + 1 - left_out, 0)
        assert got.count() == n - left_out and got.select("__row").distinct().count() == n - left_out
        assert [r[0] for r in small.orderBy("id").select("__row").collect()] == list(range(2, 102))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_row_diff_of_a_table_with_itself_dealt_differently(spark):
    frame = spark.range(0, 200_000, 1, 5).select("id", (F.col("id") * 3).alias("x"))
    spec = {"baseline": "A", "mode": {"type": "row"}, "compareColumns": "*", "filters": [], "columnAliases": {}, "normalization": {"columns": {}}, "duplicateKeyPolicy": "report"}
    r = diff.compare([from_frame("A", frame, order_by=["id"]), from_frame("B", frame.repartition(11), order_by=["id"])], spec)
    assert {x["status"]: x["count"] for x in r.classified.groupBy("status").count().collect()} == {"identical": 200_000}


def test_rows_dealt_before_are_numbered_where_they_are(spark):
    """Nulls, ties of the key, partitions emptied by a filter; a frame in another order is refused."""
    frame = spark.range(0, 40_000, 1, 5).select((F.lit(9_999) - F.floor(F.col("id") / 4)).alias("k"), "id").withColumn("k", F.when(F.col("k") > 5, F.col("k")))
    dealt = tables.ranged(frame, ["k"]).withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy("id"))).where("k is null or k > 9000")
    got = from_frame("A", dealt, order_by=["k", "place"], dealt=True).frame.orderBy("__row").collect()
    want = sorted(((-1 if 9_999 - i // 4 <= 5 else 9_999 - i // 4, i) for i in range(40_000) if not 5 < 9_999 - i // 4 <= 9_000))
    assert [(r["__row"], -1 if r["k"] is None else r["k"], r["id"]) for r in got] == [(n, *x) for n, x in enumerate(want, 2)]
    assert from_frame("A", dealt.where("k = 0"), order_by=["k", "place"], dealt=True).frame.count() == 0
    with pytest.raises(ValueError, match="dealt to ranges of k"):
        from_frame("A", frame.repartition(4, "id"), order_by=["k", "id"], dealt=True)


def test_row_diff_large_exchanges_its_rows_once_for_each_version(spark, monkeypatch):
    plans, write = [], tables.written
    monkeypatch.setattr(tables, "written", lambda df, *a, **b: plans.append(plan_of(df)) or write(df, *a, **b))
    tree = plan_of(entry.queries()["row_diff_large"](spark, SF)).split("\n\n")[0]
    assert [len(set(re.findall(r"\(\d+\) Exchange", p))) for p in plans] == [1, 1]
    # the hashes are exchanged before they are aggregated: two exchanges, the first of them for the counts by status
    assert [x for x in re.findall("Aggregate|Exchange|Union", tree.split("BroadcastExchange")[0])] == ["Aggregate", "Exchange", "Aggregate", "Aggregate", "Aggregate", "Exchange", "Union"]


def plan_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_plans(spark):
    """Filters reach the scans; classification is a hash aggregation with one exchange."""
    q = entry.queries()
    assert "EqualTo(o_orderstatus,F)" in plan_of(q["filter_eq"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in plan_of(q["filter_date_ordered"](spark, SF))
    assert "LessThanOrEqual(o_totalprice,150000.0)" in plan_of(q["filter_between"](spark, SF))
    assert "Not(EqualTo(o_orderstatus,F))" in plan_of(q["filter_ne"](spark, SF))
    two = plan_of(q["filter_two"](spark, SF))
    assert two.count("EqualTo(o_orderstatus,F)") >= 2 and "LessThanOrEqual(o_totalprice,250000.0)" in two
    status = plan_of(orders_diff(spark, SF).classified)
    assert "SortAggregate" not in status and len(set(re.findall(r"\(\d+\) Exchange", status))) == 1
    summed = plan_of(diff.summed(orders_diff(spark, SF)))
    assert "SortAggregate" not in summed and summed.count("hashpartitioning") <= 2


def test_filters_that_fail_come_after_those_that_leave_a_row_out(spark):
    a = [("1", "x"), ("2", "y")]
    frame = spark.createDataFrame(a, "id string, x string").withColumn("d", F.lit("2026-01-01").cast("date"))
    mode = {"baseline": "A", "mode": {"type": "key", "keyColumns": ["id"]}}
    bad = {"column": "d", "operator": "eq", "value": "no date"}
    none = {"column": "x", "operator": "eq", "value": "z"}
    r = diff.frames(spark, {"A": frame, "B": frame}, mode | {"filters": [none, bad]})
    assert r.classified.count() == 0 and diff.summary(r, 2)["totalRowsScanned"] == 4
    r = diff.frames(spark, {"A": frame, "B": frame}, mode | {"filters": [bad, none]})
    with pytest.raises(Exception, match="FILTER_INVALID"):
        r.classified.collect()


def test_filters_of_mixed_types(spark):
    rows = [("1", 1.0, True, "A "), ("2", None, None, ""), ("3", 3.0, False, None), ("4", -0.0, True, "b")]
    frame = spark.createDataFrame(rows, "id string, n double, t boolean, s string")

    def ids(**f):
        spec = {"baseline": "A", "mode": {"type": "key", "keyColumns": ["id"]}, "filters": [f], "normalization": {"columns": {"s": {"trim": True, "caseSensitive": False, "emptyEqualsNull": True}, "n": {"numericTolerance": 0.5} if f["operator"] in ("ne", "eq") else {}}}}
        return sorted(x["v0"] for x in diff.frames(spark, {"A": frame, "B": frame}, spec).classified.collect())

    assert ids(column="n", operator="eq", value=0) == ["4"] and ids(column="n", operator="ne", value=0.6) == ["2", "3", "4"]
    assert ids(column="n", operator="notIn", values=[1, None]) == ["3", "4"] and ids(column="n", operator="in", values=[1, None, "x"]) == ["1", "2"]
    assert ids(column="n", operator="ne", value="x") == ["1", "2", "3", "4"] and ids(column="n", operator="gt", value="x") == []
    assert ids(column="t", operator="eq", value=True) == ["1", "4"] and ids(column="t", operator="gte", value=True) == []
    assert ids(column="s", operator="eq", value="a") == ["1"] and ids(column="s", operator="isNull") == ["2", "3"] and ids(column="s", operator="ne", value=None) == ["1", "4"]
    assert ids(column="s", operator="contains", value="B") == ["4"]


def test_hash_of_rows_tells_nulls_apart(spark):
    r = compare_frames(spark, [("1", "a", None), ("2", None, None)], [("1", None, "a"), ("2", None, None)], "id string, x string, y string")
    assert {x["v0"]: x["status"] for x in r.classified.collect()} == {"1": "changed", "2": "identical"}
    assert [(x["column"], x["file0"]["value"]["str"]) for x in r.changed.orderBy("place").collect()] == [("x", "a"), ("y", None)]


def test_aliases_by_matching():
    def mapped(texts, names, aliases):
        try:
            return mapping.map_columns(mapping.headers_of(texts), names, aliases)
        except InputError as e:
            return str(e)

    # brute force over small alias graphs: the only perfect matching, or none
    for seed in range(400):
        rng = random.Random(seed)
        n = rng.randint(1, 4)
        texts, names = [f"h{i}" for i in range(n)], [f"n{i}" for i in range(rng.randint(1, 4))]
        aliases = {x: [h for h in texts if rng.random() < 0.5] for x in names}
        open_names = [x for x in names if aliases[x]]
        used = {h for x in open_names for h in aliases[x]}
        forced = {x for x in open_names if len(aliases[x]) == 1 and sum(aliases[x][0] in aliases[y] for y in open_names) == 1}
        rest, left = [x for x in open_names if x not in forced], used - {aliases[x][0] for x in forced}
        solutions = [p for p in itertools.permutations(sorted(left)) if len(rest) == len(left) and all(h in aliases[x] for x, h in zip(rest, p, strict=True))]
        got = mapped(texts, names, aliases)
        if len(rest) != len(left) or rest and len(solutions) != 1:
            assert isinstance(got, str), (aliases, got)
        else:
            assert got == {x: texts.index(aliases[x][0]) + 1 for x in forced} | ({x: texts.index(h) + 1 for x, h in zip(rest, solutions[0], strict=True)} if rest else {})
    assert mapped(["x", "y"], ["p"], {"p": ["x", "y"]}) == "multiple source columns map to standard column p"
    assert mapped(["x"], ["p", "q"], {"p": ["x"], "q": ["x"]}) == "source column x maps to multiple standard columns"
    wide = [f"n{i}" for i in range(60)]
    assert "maps to multiple" in mapped([f"h{i}" for i in range(60)], wide, {x: [f"h{i}" for i in range(60)] for x in wide})


def test_shared_strings_stay_compressed():
    texts = [f"text {i} é" for i in range(10_000)]
    strings = xlsx.Strings(iter(texts))
    assert [strings[i] for i in (0, 9_999, 2047, 2048, 5)] == [texts[i] for i in (0, 9_999, 2047, 2048, 5)]
    with pytest.raises(ValueError):
        strings[10_000]


@pytest.fixture()
def books(tmp_path):
    write(tmp_path / "a.xlsx", [["id", "name"], ["1", "before"], ["2", "deleted"], ["4", "duplicate"]])
    write(tmp_path / "b.xlsx", [["id", "name"], ["1", "after"], ["3", "added"], ["4", "duplicate"], ["4", "again"]])

    def of(**more):
        return check_spec(spec(**more), str(tmp_path))

    return of


def code_of(k):
    return hashlib.sha256(json.dumps([["string", k]], separators=(",", ":")).encode()).digest()


class Collected:
    def __init__(self):
        self.changed_, self.missing_, self.duplicate_ = [], [], []
        self.sink = Sink(changed=self.changed_.append, missing=self.missing_.append, duplicate=self.duplicate_.append)


def test_callbacks(spark, books):
    c = Collected()
    summary = run.compare_with(spark, books(), c.sink)
    assert summary == {"files": 2, "totalRowsScanned": 7, "matchedRows": 7, "identicalKeys": 0, "changedKeys": 1, "missingKeys": 2, "duplicateKeys": 1, "invalidRows": 0}
    assert c.changed_ == [{"key": [["string", "1"]], "sheetName": "data", "column": "name", "files": {"A": {"value": ["string", "before"], "rowNumber": 2}, "B": {"value": ["string", "after"], "rowNumber": 2}}}]
    assert [(x["key"][0][1], x["baselineRelation"]) for x in c.missing_] == sorted([("3", "ADDED"), ("2", "DELETED")], key=lambda x: code_of(x[0]))
    assert c.duplicate_ == [{"key": [["string", "4"]], "files": ["B"]}]
    counts = []
    run.compare_with(spark, books(mode={"type": "multiset"}, compareColumns=["name"]), Sink(multiset=counts.append))
    assert {x["values"][0][1]: x["counts"] for x in counts}["again"] == {"A": 0, "B": 1}

    class Stop(Exception):
        pass

    def stop(item):
        raise Stop

    with pytest.raises(Stop):
        run.compare_with(spark, books(), Sink(missing=stop))


def test_groups_come_in_the_order_of_their_hashes(spark, tmp_path):
    keys = [str(i) for i in range(60)]
    write(tmp_path / "a.xlsx", [["id", "x"], *([k, "x" * 80] for k in keys)])
    write(tmp_path / "b.xlsx", [["id", "x"]])

    def order(limit):
        c = Collected()
        run.compare_with(spark, check_spec(spec(resources={"maxPartitionBytes": limit}), str(tmp_path)), c.sink)
        return [x["key"][0][1] for x in c.missing_]

    assert order(1_000_000) == sorted(keys, key=lambda k: (code_of(k)[0], k))
    assert order(450) == sorted(keys, key=code_of)  # no part of two keys fits


def test_limits_and_failed_summaries(spark, books, tmp_path):
    def failed(clock=None, **more):
        out = books(**more)
        before = set(os.listdir(tmp_path / "out")) if (tmp_path / "out").exists() else set()
        with pytest.raises(Exception) as e:
            run.compare_spec(spark, out, **({"clock": clock} if clock else {}))
        (new,) = set(os.listdir(tmp_path / "out")) - before
        said = json.loads((tmp_path / "out" / new / "summary.json").read_text())
        assert os.listdir(tmp_path / "out" / new) == ["summary.json"] and said["status"] == "FAILED" and said["code"] == e.value.code
        return e.value.code

    assert failed(resources={"maxRows": 3}) == "ROW_LIMIT_EXCEEDED" and failed(resources={"maxCells": 8}) == "CELL_LIMIT_EXCEEDED"
    assert failed(resources={"maxTempBytes": 10}) == "TEMP_LIMIT_EXCEEDED" and failed(resources={"maxInputBytes": 10}) == "INPUT_LIMIT_EXCEEDED"
    assert failed(resources={"maxPartitionBytes": 300}) == "HOT_KEY_TOO_LARGE"  # three rows of key 4, not one of them alone
    assert failed(duplicateKeyPolicy="fail") == "DUPLICATE_KEY" and failed(compareColumns=["none"]) == "COLUMN_MISSING"
    assert failed(sheet={"name": "none", "headerRow": 1}) == "SHEET_NOT_FOUND"
    for at in (1, 4, 7):  # over at one of the checks
        ticks = itertools.count()
        assert failed(clock=lambda t=ticks, a=at: 1e9 if next(t) >= a else 0.0, resources={"maxRuntimeMs": 100_000}) == "RUNTIME_LIMIT_EXCEEDED"


def test_runtime_is_checked_after_each_item_and_cancels_its_own_jobs_only(spark, books):
    now = [0.0]

    def late(item):
        now[0] = 1e9

    with pytest.raises(DriftError) as e:
        run.compare_with(spark, books(), Sink(missing=late), clock=lambda: now[0])
    assert e.value.code == "RUNTIME_LIMIT_EXCEEDED"
    slow = F.pandas_udf("long")(_slow)
    with pytest.raises(DriftError) as e, run.Deadline(spark, 500):
        spark.range(4).select(slow("id")).collect()
    assert e.value.code == "RUNTIME_LIMIT_EXCEEDED"
    assert spark.range(5).count() == 5


def _slow(ids: pd.Series) -> pd.Series:
    time.sleep(8)
    return ids


def test_progress_and_kept_tables(spark, tmp_path):
    for name in ("a", "b"):
        write(tmp_path / f"{name}.xlsx", [["id", "name"], *([str(i), f"name-{i}"] for i in range(1001))])
    (tmp_path / "spec.json").write_text(json.dumps(spec()))
    out, err = io.StringIO(), io.StringIO()
    assert main(["compare", "--keep-temp", "--progress", "--spec", str(tmp_path / "spec.json")], spark, out, err) == 0, err.getvalue()
    events = [json.loads(x) for x in err.getvalue().splitlines()]
    assert [(e["rowsScanned"], e["currentFile"]) for e in events] == [(1000, "A"), (2000, "B"), (2002, "B")]
    assert 0 < events[0]["bytesWritten"] < events[2]["bytesWritten"] and "name-" not in err.getvalue()
    kept = json.loads(out.getvalue())["tempDirectory"]
    assert len(os.listdir(kept.removeprefix("file:"))) == 2
    shutil.rmtree(kept.removeprefix("file:"))
    err = io.StringIO()
    (tmp_path / "bad.json").write_text(json.dumps(spec(resources={"maxRows": 5})))
    assert main(["compare", "--keep-temp", "--spec", str(tmp_path / "bad.json")], spark, io.StringIO(), err) == 5
    said = json.loads(err.getvalue())
    assert said["code"] == "ROW_LIMIT_EXCEEDED" and os.listdir(said["tempDirectory"].removeprefix("file:"))
    shutil.rmtree(said["tempDirectory"].removeprefix("file:"))


def test_tables_go_when_they_are_dropped(spark):
    before = store.mark()
    one, two = (store.written(spark.range(3), "t") for _ in range(2))
    store.drop_since(before, two)
    assert store.mark() - before == {two._written_path} and two.count() == 3 and store.bytes_of(two) > 0
    store.drop(two)
    assert store.mark() == before
