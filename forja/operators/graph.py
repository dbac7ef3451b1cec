"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forja.staging import temporary


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b after every node has tied its larger (or smaller) neighbours to its smallest one."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    tied = both.join(least.hint("merge"), "a")  # both grow with the edges: the driver builds neither
    if large:
        tied = tied.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        tied = tied.select("b", "m").unionAll(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.where("a > b").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(a, b) of each node that has an edge and is not the smallest of its component, and that smallest node.

    ``edges`` has two columns of one type; direction, repetition and loops do
    not matter, NULL ends are left out.  Each round ties neighbours to smaller
    nodes in two steps, so rounds grow with the logarithm of the longest path;
    no task sees a whole component.
    """
    x, y = edges.columns
    at = edges.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(x) != F.col(y))).select(
        F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    seen = None
    while True:
        at = temporary(spark, _stars(_stars(at, True), False), "components")
        mark = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            return at
        seen = mark
