"""Connected components by alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of edges (a, b); loops and repeated edges do no harm.

    A step sends each edge once by each end and aggregates minima before the shuffle.  The join that gives a node's
    edges its minimum gathers them by node; where that makes a task too large, adaptive execution splits it (an
    inner join whose result is dealt anew)."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = c.written(edges, "components")
    state = _state(edges)
    while True:
        before = edges
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "n")
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(smallest, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.unionByName(smallest.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        edges = c.written(small, "components")
        c.drop_written(before)
        after = _state(edges)
        if after == state:
            break
        state = after
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
