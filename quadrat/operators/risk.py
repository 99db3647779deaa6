"""Visual risk scores: unknown attributes span their whole range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.functions import scalar as S

SCALE_POINTS = {"tiny": 1.0, "small": 0.75, "medium": 0.35, "large": 0.0}
DISCOUNT_POINTS = {"none": 0.0, "low": 0.25, "mid": 0.5, "high": 1.0}
TAX_POINTS = {"low": 0.25, "high": 1.0}
LINE_POINTS = {"F": 1.0, "O": 0.0}
#: Schemes: dimension weights; equal parts, or the early scheme that counts size twice.
SCHEMES = {"equal": (1.0, 1.0, 1.0, 1.0), "early": (2.0, 1.0, 1.0, 1.0)}

_CASES = {
    "scale": "CASE scale WHEN 'tiny' THEN 1.0 WHEN 'small' THEN 0.75 WHEN 'medium' THEN 0.35 ELSE 0.0 END",
    "discount": "CASE discount_band WHEN 'none' THEN 0.0 WHEN 'low' THEN 0.25 WHEN 'mid' THEN 0.5 ELSE 1.0 END",
    "tax": "CASE tax_band WHEN 'low' THEN 0.25 WHEN 'high' THEN 1.0 END",
    "line": "CASE linestatus WHEN 'F' THEN 1.0 ELSE 0.0 END",
}
COMPONENT_SQL = f"cp AS (SELECT sample_id, {_CASES['scale']}::DOUBLE AS a, {_CASES['tax']}::DOUBLE AS b FROM targets), comp AS (SELECT sample_id, (a * 3 + coalesce(b, 0)) / 4 AS lo, (a * 3 + coalesce(b, 1)) / 4 AS hi, (3 + (b IS NOT NULL)::INT) / 4 AS kn FROM cp)"
SCORE_SQL = f"""sc AS (SELECT *, {_CASES['scale']}::DOUBLE AS a, {_CASES['discount']}::DOUBLE AS b, {_CASES['tax']}::DOUBLE AS c, {_CASES['line']}::DOUBLE AS d FROM targets),
scores AS (SELECT sample_id, class_name, split, round((a + b + coalesce(c, 0) + d) * 25, 6) AS low, round((a + b + coalesce(c, 1) + d) * 25, 6) AS high, round((a + b + d + (coalesce(c, 0) + coalesce(c, 1)) / 2) * 25, 6) AS mid, (3 + (c IS NOT NULL)::INT) / 4 AS known FROM sc)"""


def dimensions() -> list[Column]:
    """The four dimensions of a target, each in [0, 1] or null."""
    return [S.mapped(F.col("scale"), SCALE_POINTS), S.mapped(F.col("discount_band"), DISCOUNT_POINTS), S.mapped(F.col("tax_band"), TAX_POINTS), S.mapped(F.col("linestatus"), LINE_POINTS)]


def components() -> Column:
    """Size three parts, tax one part."""
    return S.interval([(S.mapped(F.col("scale"), SCALE_POINTS), 3.0), (S.mapped(F.col("tax_band"), TAX_POINTS), 1.0)])


def scores(targets: DataFrame, scheme: str = "equal", without: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """low, high and mid of the 0-100 score, and the known weight; ``without`` drops a dimension, ``keep`` are further columns.

    Scores are rounded, so sums taken in another order tie alike.
    """
    parts = [(d, w) for i, (d, w) in enumerate(zip(dimensions(), SCHEMES[scheme], strict=True)) if i != without]
    s = targets.withColumn("_s", S.interval(parts))
    return s.select("sample_id", "class_name", "split", *[F.round(F.col(f"_s.{a}") * 100, 6).alias(b) for a, b in (("lower", "low"), ("upper", "high"), ("midpoint", "mid"))], F.col("_s.known").alias("known"), *keep)


def points_13(targets: DataFrame) -> DataFrame:
    """0 to 13 points; an unknown part spans 0 to its largest value."""
    known = F.when(F.col("scale") == "tiny", 3).when(F.col("scale") == "small", 2).when(F.col("scale") == "medium", 1).otherwise(0)
    known = known + F.when(F.col("discount_band") == "high", 4).when(F.col("discount_band") == "mid", 2).otherwise(0) + F.when(F.col("linestatus") == "F", 2).otherwise(0)
    tax = F.when(F.col("tax_band") == "high", 4).when(F.col("tax_band") == "low", 1)
    low, high = known + F.coalesce(tax, F.lit(0)), known + F.coalesce(tax, F.lit(4))
    return targets.select("sample_id", low.alias("low"), high.alias("high"), ((low + high) / 2).alias("mid"), tax.isNull().cast("int").alias("n_unknown"))


def difficulty() -> Column:
    """Logarithm of the size plus points; here unknown counts 0."""
    size = F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.log10(0.1 / F.col("area_ratio"))))
    return size + F.when(F.col("discount_band") == "high", 2).when(F.col("discount_band") == "mid", 1).otherwise(0) + F.when(F.col("tax_band") == "high", 1).otherwise(0)


def rarity(counts: DataFrame) -> DataFrame:
    """1 - (n + 1) / (largest n of the field + 1)."""
    top = F.max("n").over(Window.partitionBy("class_name", "field"))
    return counts.withColumn("rarity", 1 - (F.col("n") + 1) / (top + 1))


def panel_share_wrong(facts: DataFrame, size: int) -> DataFrame:
    """Share of a fixed panel that is wrong; null if a member is missing, so the denominator never shrinks."""
    return facts.groupBy("sample_id").agg(F.when(F.count_if("valid") == size, F.avg(1 - F.col("correct"))).alias("score"))


def expected_unique(counts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """Exact expected number of distinct values in k draws without replacement.

    log C(a, k) - log C(b, k) is a sum of k logarithms of ratios, so no table of
    factorials is needed and no value overflows.
    """
    total = F.sum("n").over(Window.partitionBy(*by))
    c = counts.withColumn("total", total).where(F.col("total") >= k)
    a, t = F.col("total") - F.col("n"), F.col("total")
    missed = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + F.log((a - i) / (t - i)))
    return c.groupBy(*by).agg(F.sum(1 - F.when(a < k, 0.0).otherwise(F.exp(missed))).alias("expected"))
