"""Connected components of a distributed graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import stored


#: Parts that the edges of one node are dealt to in a join, so that a hub isn't one task's work.
SALTS = 8


def _with(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (a, b) with the columns that ``low`` has for a."""
    parts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    return salted.join(low.withColumn("salt", parts).hint("merge"), ["a", "salt"]).drop("salt")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def roots(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of ``edges`` (a, b).

    Large-star and small-star steps in turn until nothing changes: a logarithmic
    number of rounds, each a pre-aggregated minimum and a salted join on the node.
    Each round is written to the shared folder.  Loops, repeated and reversed
    edges are fine; a null end drops the edge.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    e = stored(e, "components")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with(both, low).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = _with(large, low)
        small = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e = stored(small, "components")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
