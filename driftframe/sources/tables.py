"""Versions of a table: a DataFrame with an id and the physical number of each row."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

ROW = "__row"
CELLS = "__cells"
PART, PLACE = "__df_part", "__df_place"


class Version(NamedTuple):
    """frame has ROW where rows have numbers; headers are its columns in order."""

    id: str
    frame: DataFrame
    headers: list[str | None]
    columns: list[str]  # the frame's column of each header
    sheet: str = "data"


def from_frame(file_id: str, frame: DataFrame, order_by: list[str] | None = None, row_column: str | None = None, sheet: str = "data", dealt: bool = False) -> Version:
    """A DataFrame as a version.

    Rows are numbered from 2 (a header takes row 1) in the order of order_by, which must be unique for a stable
    result, or by an existing row_column.  The numbering is global and so takes one sorted pass, which is run here;
    key and multiset comparisons need none.  dealt: the frame comes from ranged() by the first of order_by, so its
    rows aren't exchanged once more."""
    names = [x for x in frame.columns if x != row_column]
    if row_column:
        frame = frame.withColumn(ROW, F.col(row_column).cast("long"))
    elif order_by:
        frame = numbered(frame, order_by, dealt)
    else:
        frame = frame.withColumn(ROW, F.lit(None).cast("long"))
    return Version(file_id, frame, list(names), list(names), sheet)


def ranged(frame: DataFrame, by: list[str]) -> DataFrame:
    """A frame dealt to ranges of some columns, for numbered(): a window by these columns needs no exchange of its own."""
    return frame.repartitionByRange(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def numbered(frame: DataFrame, order_by: list[str], dealt: bool = False) -> DataFrame:
    """Row numbers over a range-partitioned sort: counts of the partitions before are added to local ranks.

    The sorted rows, with their partition and their place in it, are written once: both the counts and the rows
    are read from that one table, so they can't disagree.  No row passes through a single task; what is broadcast
    has one row for each partition of the sort.  dealt: rows stay in their partitions, which must follow each other
    in the order; their first and last rows are compared, since numbers would be wrong otherwise."""
    rows = (frame if dealt else ranged(frame, order_by)).sortWithinPartitions(*order_by)
    rows = written(rows.withColumns({PART: F.spark_partition_id(), PLACE: F.monotonically_increasing_id()}), "numbered", compression="zstd")
    counts = rows.groupBy(F.col(PART).alias("__df_of")).agg(F.count("*").alias("__df_n"), F.min(PLACE).alias("__df_first"))
    earlier = Window.orderBy("__df_of").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("__df_before", F.coalesce(F.sum("__df_n").over(earlier), F.lit(0)))
    joined = rows.join(F.broadcast(before), F.col(PART) == F.col("__df_of"), "left")
    place = F.col(PLACE) - F.col("__df_first")
    if dealt:
        ends = joined.where((place == 0) | (place == F.col("__df_n") - 1)).select(PLACE, F.struct(*order_by).alias("at"))
        if ends.select((F.lag("at").over(Window.orderBy(PLACE)) > F.col("at")).alias("wrong")).where("wrong").head(1):
            raise ValueError(f"the frame isn't dealt to ranges of {order_by[0]}")
    return joined.withColumn(ROW, F.col("__df_before") + place + 2).drop(PART, PLACE, "__df_of", "__df_first", "__df_n", "__df_before")


def from_parquet(spark: SparkSession, file_id: str, path: str, **how) -> Version:
    return from_frame(file_id, spark.read.parquet(path), **how)


def from_csv(spark: SparkSession, file_id: str, path: str, schema=None, **how) -> Version:
    """A CSV file with a header; every column is text unless a schema says otherwise."""
    reader = spark.read.option("header", True)
    return from_frame(file_id, (reader.schema(schema) if schema else reader).csv(path), **how)
