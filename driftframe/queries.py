"""Registered queries over the test tables, and their SQL.

The second version of a table is derived from the first by fixed rules: rows deleted, values altered, keys added,
rows repeated.  Queries return plain columns, so that a row-by-row comparison with SQL is possible.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.cells import Typed, to_cell
from .operators import diff, profile
from .plans.spec import OPERATORS
from .sinks.report import encoded, safe_text
from .sources.tables import from_frame, ranged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


def altered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = orders(spark, sf_dir)
    price = F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    status = F.when(F.col("o_orderkey") % 17 == 0, F.lit(None)).otherwise(F.col("o_orderstatus"))
    kept = base.where("o_orderkey % 97 <> 0").withColumns({"o_totalprice": price, "o_orderstatus": status})
    added = base.where("o_orderkey % 1000 = 5").withColumn("o_orderkey", F.col("o_orderkey") + 1000000)
    return kept.unionByName(added).unionByName(base.where("o_orderkey % 101 = 0"))


BOTH_ORDERS = """
a AS (SELECT o_orderkey AS k, o_custkey, o_orderstatus, o_totalprice FROM orders),
b AS (
  SELECT k, o_custkey, CASE WHEN k % 17 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN k % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM a WHERE k % 97 <> 0
  UNION ALL SELECT k + 1000000, o_custkey, o_orderstatus, o_totalprice FROM a WHERE k % 1000 = 5
  UNION ALL SELECT * FROM a WHERE k % 101 = 0
),
ga AS (SELECT k, count(*) AS n, any_value(o_custkey) AS c0, any_value(o_orderstatus) AS c1, any_value(o_totalprice) AS c2 FROM a GROUP BY k),
gb AS (SELECT k, count(*) AS n, any_value(o_custkey) AS c0, any_value(o_orderstatus) AS c1, any_value(o_totalprice) AS c2 FROM b GROUP BY k),
g AS (
  SELECT coalesce(ga.k, gb.k) AS k, coalesce(ga.n, 0) AS n0, coalesce(gb.n, 0) AS n1, ga.c1 AS a1, gb.c1 AS b1, ga.c2 AS a2, gb.c2 AS b2,
         ga.c0 IS DISTINCT FROM gb.c0 AS d0, ga.c1 IS DISTINCT FROM gb.c1 AS d1, ga.c2 IS DISTINCT FROM gb.c2 AS d2
  FROM ga FULL JOIN gb ON ga.k = gb.k
),
s AS (SELECT *, CASE WHEN n0 > 1 OR n1 > 1 THEN 'duplicate' WHEN n0 = 0 OR n1 = 0 THEN 'missing' WHEN d0 OR d1 OR d2 THEN 'changed' ELSE 'identical' END AS status FROM g)
"""


def orders_diff(spark: SparkSession, sf_dir: str) -> diff.Result:
    return diff.frames(spark, {"A": orders(spark, sf_dir), "B": altered_orders(spark, sf_dir)}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["o_orderkey"]}})


def number(cell: str):
    return F.col(f"{cell}.num")


def key_diff_status(spark, sf_dir):
    return orders_diff(spark, sf_dir).classified.groupBy("status").agg(F.count("*").alias("n"))


def key_diff_summary(spark, sf_dir):
    return diff.summed(orders_diff(spark, sf_dir)).drop("cells")


def key_diff_changed_cells(spark, sf_dir):
    return orders_diff(spark, sf_dir).changed.select(F.col("key")[0]["num"].cast("long").alias("k"), "column", F.col("file0.value.type").alias("base_type"), F.col("file1.value.type").alias("other_type"), number("file0.value").alias("base_num"), number("file1.value").alias("other_num"), F.col("file0.value.str").alias("base_str"), F.col("file1.value.str").alias("other_str"))


def key_diff_missing(spark, sf_dir):
    return orders_diff(spark, sf_dir).missing.select(F.col("key")[0]["num"].cast("long").alias("k"), F.array_join("presentFiles", ",").alias("present"), F.array_join("missingFiles", ",").alias("missing"), "baselineRelation")


def key_diff_duplicates(spark, sf_dir):
    return orders_diff(spark, sf_dir).duplicates.select(F.col("key")[0]["num"].cast("long").alias("k"), F.array_join("files", ",").alias("files"))


def key_diff_three_way(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    b = a.where("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, F.col("c_acctbal") * 2).otherwise(F.col("c_acctbal")))
    c = a.where("c_custkey % 19 <> 0").unionByName(a.where("c_custkey % 23 = 0"))
    r = diff.frames(spark, {"C": c, "A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["c_custkey"]}})
    return r.classified.select(F.col("v0").alias("k"), F.col("n0").alias("n_c"), F.col("n1").alias("n_a"), F.col("n2").alias("n_b"), "status")


def key_diff_composite(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    b = a.withColumn("l_quantity", F.when(F.col("l_orderkey") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["l_orderkey", "l_linenumber"]}})
    return r.classified.groupBy("status").agg(F.count("*").alias("n"), F.sum("v0").alias("sum_key"))


def key_diff_tolerance(spark, sf_dir):
    a = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    b = a.withColumn("p_retailprice", F.col("p_retailprice") + (F.col("p_partkey") % 5) * 0.25)
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["p_partkey"]}, "normalization": {"columns": {"p_retailprice": {"numericTolerance": 0.6}}}})
    return r.classified.select(F.col("v0").alias("k"), "status")


def key_diff_normalized(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    b = a.select("c_custkey", F.concat(F.lit(" \t"), F.lower("c_mktsegment")).alias("c_mktsegment"), F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("c_name"))
    a = a.withColumn("c_name", F.when(F.col("c_custkey") % 6 == 0, F.lit(None)).otherwise(F.col("c_name")))
    rules = {"c_mktsegment": {"trim": True, "caseSensitive": False}, "c_name": {"emptyEqualsNull": True}}
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["c_custkey"]}, "normalization": {"columns": rules}})
    return r.classified.select(F.col("v0").alias("k"), "status")


def key_diff_invalid_keys(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    b = a.withColumn("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, F.lit(None)).otherwise(F.col("s_suppkey")))
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["s_suppkey"]}})
    return r.counters.select("file", "total", "matched", "invalid")


def row_diff(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    b = a.where("s_suppkey % 40 <> 0")
    spec = {"baseline": "A", "mode": {"type": "row"}, "compareColumns": "*", "filters": [], "columnAliases": {}, "normalization": {"columns": {}}, "duplicateKeyPolicy": "report"}
    r = diff.compare([from_frame("A", a, order_by=["s_suppkey"]), from_frame("B", b, order_by=["s_suppkey"])], spec)
    keys = r.aligned.select(F.col("__row").alias("r"), F.col("f0.c0").alias("base_key"), F.col("f1.c0").alias("other_key"))
    return r.classified.join(keys, F.col("__row") == F.col("r")).select(F.col("__row").alias("row_number"), "base_key", "other_key", "status")


def row_diff_large(spark, sf_dir):
    """A wide table of many rows, numbered by a unique order, against one without its every 500th order and with others altered."""
    numbers = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    a = ranged(table(spark, sf_dir, "lineitem"), ["l_orderkey"]).withColumn("place", F.row_number().over(numbers))
    b = a.where("l_orderkey % 500 <> 499").withColumn("l_tax", F.when(F.col("l_partkey") % 7 == 0, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    spec = {"baseline": "A", "mode": {"type": "row"}, "compareColumns": "*", "filters": [], "columnAliases": {}, "normalization": {"columns": {}}, "duplicateKeyPolicy": "report"}
    r = diff.compare([from_frame("A", a, order_by=["l_orderkey", "place"], dealt=True), from_frame("B", b, order_by=["l_orderkey", "place"], dealt=True)], spec)
    return r.classified.groupBy("status").agg(F.count("*").alias("n"), F.sum("__row").alias("row_sum"))


def filter_two(spark, sf_dir):
    """Two filters before a key diff; both reach the scans."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    b = a.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice")))
    filters = [{"column": "o_orderstatus", "operator": "eq", "value": "F"}, {"column": "o_totalprice", "operator": "between", "values": [50000, 250000]}]
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "key", "keyColumns": ["o_orderkey"]}, "filters": filters})
    return r.classified.select(F.col("v0").alias("k"), "n0", "n1", "status")


def multiset_diff(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 20).alias("u"))
    b = table(spark, sf_dir, "events").where("event_id % 50 <> 0").select("event_type", (F.col("user_id") % 20).alias("u"))
    r = diff.frames(spark, {"A": a, "B": b}, {"baseline": "A", "mode": {"type": "multiset"}})
    return r.multiset.select(F.col("values")[0]["str"].alias("event_type"), F.col("values")[1]["num"].cast("long").alias("u"), F.col("count0").alias("n_a"), F.col("count1").alias("n_b"), "baselineRelation")


def column_alias_mapping(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    b = a.select(F.col("n_regionkey").alias("region"), F.upper("n_name").alias("ｎ_name"), F.col("n_nationkey").alias("Key"))
    spec = {"baseline": "A", "mode": {"type": "key", "keyColumns": ["n_nationkey"]}, "columnAliases": {"n_nationkey": ["Key"], "n_regionkey": ["region"]}}
    r = diff.frames(spark, {"A": a, "B": b}, spec)
    return r.classified.select(F.col("v0").alias("k"), "status")


# ---- filters: (table, key, column, operand fields, SQL predicate)

FILTERS = {
    "eq": ("orders", "o_orderkey", "o_orderstatus", {"value": "F"}, "o_orderstatus = 'F'"),
    "ne": ("orders", "o_orderkey", "o_orderstatus", {"value": "F"}, "o_orderstatus IS DISTINCT FROM 'F'"),
    "gt": ("orders", "o_orderkey", "o_totalprice", {"value": 100000}, "o_totalprice > 100000"),
    "gte": ("part", "p_partkey", "p_size", {"value": 25}, "p_size >= 25"),
    "lt": ("customer", "c_custkey", "c_acctbal", {"value": 0}, "c_acctbal < 0"),
    "lte": ("part", "p_partkey", "p_size", {"value": 10}, "p_size <= 10"),
    "in": ("customer", "c_custkey", "c_mktsegment", {"values": ["BUILDING", "MACHINERY", None]}, "c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "notIn": ("customer", "c_custkey", "c_mktsegment", {"value": ["BUILDING", "MACHINERY"]}, "c_mktsegment IS NULL OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    "contains": ("part", "p_partkey", "p_type", {"value": "A"}, "contains(p_type, 'A')"),
    "startsWith": ("part", "p_partkey", "p_brand", {"value": "Brand#1"}, "starts_with(p_brand, 'Brand#1')"),
    "endsWith": ("events", "event_id", "event_type", {"value": "k"}, "ends_with(event_type, 'k')"),
    "isNull": ("events", "event_id", "props", {}, "props IS NULL"),
    "isNotNull": ("events", "event_id", "props", {}, "props IS NOT NULL"),
    "between": ("orders", "o_orderkey", "o_totalprice", {"values": [50000, 150000]}, "o_totalprice BETWEEN 50000 AND 150000"),
}


def filtered(spark, sf_dir, name: str, key: str, column: str, f: dict) -> DataFrame:
    """Keys of the rows that pass a filter, through the comparison's own scan."""
    frame = table(spark, sf_dir, name).select(key, column)
    spec = {"baseline": "A", "mode": {"type": "row"}, "compareColumns": "*", "filters": [f | {"column": column}], "columnAliases": {}, "normalization": {"columns": {}}}
    scan, _ = diff.prepare(from_frame("A", frame), spec, None)
    return scan.source.where(scan.keeps).select(scan.cells[key].value.alias("k"))


def filter_date_ordered(spark, sf_dir):
    return filtered(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", {"operator": "gte", "value": "1996-01-01T08:00:00+08:00"})


# ---- profiles


def inspect_types(spark, sf_dir):
    out = None
    for name, key in (("customer", "c_custkey"), ("documents", "doc_id"), ("conversations", None)):
        frame = table(spark, sf_dir, name)
        version = from_frame(name, frame.withColumn("__n", F.lit(2)), row_column="__n")
        rows = profile.profile(version, full_types=True).select(F.lit(name).alias("tab"), F.col("header").alias("col"), F.col("n_blank").alias("blanks"), F.col("n_number").alias("numbers"), F.col("n_string").alias("strings"), F.col("typed_rows").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def inspect_empty_ratio(spark, sf_dir):
    return inspect_types(spark, sf_dir).select("tab", "col", (F.col("blanks") / F.col("n")).alias("ratio"))


def inspect_key_candidates(spark, sf_dir):
    version = from_frame("customer", table(spark, sf_dir, "customer").withColumn("__n", F.col("c_custkey") + 2), row_column="__n")
    return profile.key_candidates(profile.profile(version)).select(F.col("header").alias("col"), F.col("sampled_rows").alias("n"))


def key_sha256(spark, sf_dir):
    digest = F.udf(lambda cell: hashlib.sha256(encoded([cell]).encode("utf-8", "surrogatepass")).hexdigest())
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), digest(to_cell(Typed(F.col("n_name"), "string"))).alias("digest"))


def safe(text):
    """The reports' safe text of a column."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(safe_text, na_action="ignore")

    return run(text)


def begun(text):
    """Texts that begin in each of the ways that are encoded, and as they are."""
    return F.concat(F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "json:", ""])), (F.col("doc_id") % 6 + 1).cast("int")), text)


def csv_safe_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), safe(begun(F.col("text"))).alias("safe"))


QUERIES = {
    f.__name__: f
    for f in (key_diff_status, key_diff_summary, key_diff_changed_cells, key_diff_missing, key_diff_duplicates, key_diff_three_way, key_diff_composite, key_diff_tolerance, key_diff_normalized, key_diff_invalid_keys, row_diff, row_diff_large, multiset_diff, column_alias_mapping, filter_date_ordered, filter_two, inspect_types, inspect_empty_ratio, inspect_key_candidates, key_sha256, csv_safe_text)
}
assert set(FILTERS) == set(OPERATORS)
for _op, (_table, _key, _column, _operand, _) in FILTERS.items():
    QUERIES[f"filter_{_op}"] = lambda spark, sf_dir, t=_table, k=_key, c=_column, f={"operator": _op} | _operand: filtered(spark, sf_dir, t, k, c, f)


def _types_sql() -> str:
    columns = {"customer": {"c_custkey": 1, "c_name": 0, "c_nationkey": 1, "c_acctbal": 1, "c_mktsegment": 0}, "documents": {"doc_id": 1, "text": 0, "lang": 0, "source": 0, "n_chars": 1}, "conversations": {"conv_id": 1, "turn": 1, "role": 0, "text": 0}}
    return " UNION ALL ".join(f"SELECT '{t}' AS tab, '{c}' AS col, count(*) - count({c}) AS blanks, {f'count({c})' if n else '0'} AS numbers, {'0' if n else f'count({c})'} AS strings, count(*) AS n FROM {t}" for t, cs in columns.items() for c, n in cs.items())


ORACLE_SQL = {f"filter_{op}": f"SELECT {key} AS k FROM {tab} WHERE {sql}" for op, (tab, key, _, _, sql) in FILTERS.items()} | {
    "key_diff_status": f"WITH {BOTH_ORDERS} SELECT status, count(*) AS n FROM s GROUP BY status",
    "key_diff_summary": f"WITH {BOTH_ORDERS} SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS total_rows, (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS matched_rows, CAST(0 AS BIGINT) AS invalid_rows, "
    + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}_keys" for x in ("identical", "changed", "missing", "duplicate"))
    + " FROM s",
    "key_diff_changed_cells": f"""WITH {BOTH_ORDERS}
SELECT k, 'o_orderstatus' AS "column", CASE WHEN a1 IS NULL THEN 'blank' ELSE 'string' END AS base_type, CASE WHEN b1 IS NULL THEN 'blank' ELSE 'string' END AS other_type, CAST(NULL AS DOUBLE) AS base_num, CAST(NULL AS DOUBLE) AS other_num, a1 AS base_str, b1 AS other_str FROM s WHERE status = 'changed' AND d1
UNION ALL SELECT k, 'o_totalprice', 'number', 'number', a2, b2, NULL, NULL FROM s WHERE status = 'changed' AND d2""",
    "key_diff_missing": f"WITH {BOTH_ORDERS} SELECT k, CASE WHEN n0 > 0 THEN 'A' ELSE 'B' END AS present, CASE WHEN n0 > 0 THEN 'B' ELSE 'A' END AS missing, CASE WHEN n0 > 0 THEN 'DELETED' ELSE 'ADDED' END AS baselineRelation FROM s WHERE status = 'missing'",
    "key_diff_duplicates": f"WITH {BOTH_ORDERS} SELECT k, concat_ws(',', CASE WHEN n0 > 1 THEN 'A' END, CASE WHEN n1 > 1 THEN 'B' END) AS files FROM s WHERE status = 'duplicate'",
    "key_diff_three_way": """SELECT c_custkey AS k, CAST((c_custkey % 19 <> 0)::INT + (c_custkey % 23 = 0)::INT AS BIGINT) AS n_c, CAST(1 AS BIGINT) AS n_a, CAST((c_custkey % 11 <> 0)::INT AS BIGINT) AS n_b,
CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 23 = 0 THEN 'duplicate' WHEN c_custkey % 11 = 0 OR (c_custkey % 19 = 0 AND c_custkey % 23 <> 0) THEN 'missing' WHEN c_custkey % 7 = 0 AND c_acctbal <> 0 THEN 'changed' ELSE 'identical' END AS status FROM customer""",
    "key_diff_composite": "WITH g AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT CASE WHEN n > 1 THEN 'duplicate' WHEN k % 5 = 0 THEN 'changed' ELSE 'identical' END AS status, count(*) AS n, CAST(sum(k) AS BIGINT) AS sum_key FROM g GROUP BY 1",
    "key_diff_tolerance": "SELECT p_partkey AS k, CASE WHEN abs(p_retailprice - (p_retailprice + (p_partkey % 5) * 0.25::DOUBLE)) <= 0.6 THEN 'identical' ELSE 'changed' END AS status FROM part",
    "key_diff_normalized": "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 6 <> 0 THEN 'changed' ELSE 'identical' END AS status FROM customer",
    "key_diff_invalid_keys": "SELECT 'A' AS file, count(*) AS total, count(*) AS matched, CAST(0 AS BIGINT) AS invalid FROM supplier UNION ALL SELECT 'B', count(*), count(*) FILTER (WHERE s_suppkey % 4 <> 0), count(*) FILTER (WHERE s_suppkey % 4 = 0) FROM supplier",
    "row_diff": """WITH a AS (SELECT row_number() OVER (ORDER BY s_suppkey) + 1 AS r, s_suppkey AS k, s_acctbal AS v FROM supplier), b AS (SELECT row_number() OVER (ORDER BY s_suppkey) + 1 AS r, s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 40 <> 0)
SELECT coalesce(a.r, b.r) AS row_number, a.k AS base_key, b.k AS other_key, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'missing' WHEN a.k IS DISTINCT FROM b.k OR a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'identical' END AS status FROM a FULL JOIN b ON a.r = b.r""",
    "row_diff_large": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS place FROM lineitem),
a AS (SELECT row_number() OVER (ORDER BY l_orderkey, place) + 1 AS r, * FROM n),
b AS (SELECT row_number() OVER (ORDER BY l_orderkey, place) + 1 AS r, * REPLACE (CASE WHEN l_partkey % 7 = 0 THEN l_tax + 1 ELSE l_tax END AS l_tax) FROM n WHERE l_orderkey % 500 <> 499),
j AS (SELECT coalesce(a.r, b.r) AS r, CASE WHEN a.r IS NULL OR b.r IS NULL THEN 'missing' WHEN (a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.l_quantity, a.l_extendedprice, a.l_discount, a.l_tax, a.l_returnflag, a.l_linestatus, a.l_shipdate, a.place) IS DISTINCT FROM (b.l_orderkey, b.l_partkey, b.l_suppkey, b.l_linenumber, b.l_quantity, b.l_extendedprice, b.l_discount, b.l_tax, b.l_returnflag, b.l_linestatus, b.l_shipdate, b.place) THEN 'changed' ELSE 'identical' END AS status FROM a FULL JOIN b ON a.r = b.r)
SELECT status, count(*) AS n, CAST(sum(r) AS BIGINT) AS row_sum FROM j GROUP BY status""",
    "filter_two": """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'F' AND o_totalprice BETWEEN 50000 AND 250000),
b AS (SELECT * FROM (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS p FROM orders WHERE o_orderstatus = 'F') WHERE p BETWEEN 50000 AND 250000)
SELECT coalesce(a.k, b.k) AS k, CAST((a.k IS NOT NULL)::INT AS BIGINT) AS n0, CAST((b.k IS NOT NULL)::INT AS BIGINT) AS n1, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'missing' WHEN a.p <> b.p THEN 'changed' ELSE 'identical' END AS status FROM a FULL JOIN b ON a.k = b.k""",
    "multiset_diff": "WITH g AS (SELECT event_type, user_id % 20 AS u, count(*) AS n_a, count(*) FILTER (WHERE event_id % 50 <> 0) AS n_b FROM events GROUP BY ALL) SELECT event_type, u, n_a, n_b, 'DELETED' AS baselineRelation FROM g WHERE n_a <> n_b",
    "column_alias_mapping": "SELECT n_nationkey AS k, CASE WHEN n_name <> upper(n_name) THEN 'changed' ELSE 'identical' END AS status FROM nation",
    "filter_date_ordered": "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'",
    "inspect_types": _types_sql(),
    "inspect_empty_ratio": f"SELECT tab, col, blanks / n AS ratio FROM ({_types_sql()})",
    "inspect_key_candidates": """WITH f AS (SELECT * FROM customer WHERE c_custkey + 2 <= 10001), m AS (
"""
    + " UNION ALL ".join(f"SELECT '{c}' AS col, count(*) AS n, count({c}) AS filled, count(DISTINCT {c}) AS d FROM f" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))
    + ") SELECT col, n FROM m WHERE n > 0 AND filled = n AND d = n",
    "key_sha256": """SELECT n_nationkey AS k, sha256('[["string","' || n_name || '"]]') AS digest FROM nation""",
    "csv_safe_text": """WITH t AS (SELECT doc_id AS k, ['=', '+', '-', '@', 'json:', ''][CAST(doc_id % 6 + 1 AS INT)] || text AS x FROM documents)
SELECT k, CASE WHEN regexp_matches(x, '^([=+@\\t\\r\\n-]|json:)') THEN 'json:' || CAST(to_json(x) AS VARCHAR) ELSE x END AS safe FROM t""",
}
