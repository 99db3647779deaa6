"""Attribute states: long tables of (class, sample, field, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = ("unknown",)


def explode_fields(rows: DataFrame, fields: Sequence[str], unknown: Sequence[str] = UNKNOWN, keep: Sequence[str] = ("sample_id",)) -> DataFrame:
    """One row for each field of each target, with the columns ``keep``; unknown values dropped.  No shuffle."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])
    out = rows.select("class_name", *keep, F.inline(pairs))
    return out.where(~F.col("value").isin(*unknown)) if unknown else out


def dictionary(states: DataFrame) -> DataFrame:
    """Every (class, field, value) that is there at least once."""
    return states.select("class_name", "field", "value").distinct()


def support(states: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Rows for each state; with a universe also the states that no row has (0)."""
    n = states.groupBy("class_name", "field", "value").agg(F.count("*").alias("n"))
    if universe is None:
        return n
    return universe.join(n, ["class_name", "field", "value"], "left").select("class_name", "field", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def coverage(counts: DataFrame, cap: int, by: Sequence[str] = ("class_name",)) -> DataFrame:
    """Occurrence, completion, share at the cap and capped log over dictionary-completed counts."""
    n = F.col("n")
    return counts.groupBy(*by).agg(
        F.count("*").alias("n_states"),
        F.avg((n > 0).cast("double")).alias("occurrence"),
        F.avg(F.least(n / cap, F.lit(1.0))).alias("completion"),
        F.avg((n >= cap).cast("double")).alias("at_cap"),
        (F.avg(F.log1p(F.least(n, F.lit(cap)).cast("double"))) / F.log1p(F.lit(float(cap)))).alias("capped_log"),
    )


def band(n, edges: Sequence[int] = (1, 10, 30)):
    """missing, sparse, weak or covered."""
    return F.when(n < edges[0], "missing").when(n < edges[1], "sparse").when(n < edges[2], "weak").otherwise("covered")
