"""Quotas and draws.  Draws are orders by hash, so they are the same on every cluster."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.operators.ranking import hash_order


def largest_remainder(cells: DataFrame, by: Sequence[str], weight: str, total: Column, key: Sequence[str]) -> DataFrame:
    """``quota``: the whole part of each share, the rest to the largest remainders, ties by key.

    Whole-number arithmetic throughout; ``total`` is the budget of each ``by`` group.
    """
    w = Window.partitionBy(*by)
    c = cells.withColumn("_t", total.cast("long")).withColumn("_w", F.sum(weight).over(w))
    c = c.withColumn("_q", F.expr(f"_t * {weight} div _w")).withColumn("_r", F.expr(f"_t * {weight} % _w"))
    left = F.col("_t") - F.sum("_q").over(w)
    place = F.row_number().over(w.orderBy(F.desc("_r"), *key))
    return c.withColumn("quota", F.col("_q") + F.when(place <= left, 1).otherwise(0)).drop("_t", "_w", "_q", "_r")


def take(rows: DataFrame, quotas: DataFrame, by: Sequence[str], *order: str | Column, most: int | None = None) -> DataFrame:
    """The first ``quota`` rows of each cell in hash order of the parts; ``most``: what no quota exceeds, a limit that reaches the tasks."""
    r = hash_order(rows, by, *order, name="_n")
    r = r if most is None else r.where(F.col("_n") <= most)
    return r.join(F.broadcast(quotas.select(*by, "quota")), list(by)).where(F.col("_n") <= F.col("quota")).drop("_n", "quota")  # cells are few


def round_robin(rows: DataFrame, by: Sequence[str], bin_: str, n: int, *order: str | Column) -> DataFrame:
    """Take turns across bins, each in hash order, until ``n`` rows of each group are taken."""
    r = hash_order(rows, [*by, bin_], *order, name="_turn")
    r = r.where(F.col("_turn") <= n)  # no bin gives more
    place = F.row_number().over(Window.partitionBy(*by).orderBy("_turn", bin_))
    return r.withColumn("_place", place).where(F.col("_place") <= n).drop("_turn", "_place")


def staged(rows: DataFrame, key: str, stages: Sequence[tuple[str, Column, int]], by: Sequence[str], *order: str | Column) -> DataFrame:
    """Ordered stages, each with a condition and a limit; a row is taken once.

    A row belongs to the first stage whose limit it fits; stages are few, so the
    loop is a handful of joins.
    """
    taken = None
    for name, cond, limit in stages:
        pool = rows.where(cond)
        if taken is not None:
            pool = pool.join(taken.select(key), key, "left_anti")
        got = hash_order(pool, by, F.lit(name), *order, name="_n").where(F.col("_n") <= limit).drop("_n").withColumn("stage", F.lit(name))
        taken = got if taken is None else taken.unionByName(got)
    return taken


def matched(rows: DataFrame, method: str, cell: Sequence[str], order: str) -> DataFrame:
    """The same number of rows in each cell for every method: the smallest that any has."""
    n = rows.groupBy(method, *cell).agg(F.count("*").alias("_n"))
    methods = rows.select(method).distinct().count()
    least = n.groupBy(*cell).agg(F.when(F.count("*") == methods, F.min("_n")).otherwise(0).alias("quota"))
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(method, *cell).orderBy(order)))
    return r.join(F.broadcast(least), list(cell)).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")  # cells are few
