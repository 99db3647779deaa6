"""Agreement of two sources over the same targets and fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.sources.shared import ready


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """class_name, sample_id, field, left, right for values that both sources have (unknown counts as a value)."""
    key = ["class_name", "sample_id", "field"]
    return left.select(*key, F.col("value").alias("left")).join(right.select(*key, F.col("value").alias("right")), key)


def wide_pairs(left: DataFrame, right: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``pairs`` of tables that hold a target as one row with a column a field; rows, not their fields, are joined, by sample_id alone.

    A target has one class, that of ``left``; one without a class is left out.
    """
    r = right.select("sample_id", *[F.col(f).alias(f"_r{i}") for i, f in enumerate(fields)])
    told = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("left"), F.col(f"_r{i}").alias("right")) for i, f in enumerate(fields)])
    return left.where("class_name is not null").join(r, "sample_id").select("class_name", "sample_id", F.inline(told))


def row_pairs(rows: DataFrame, fields: Sequence[str], prefix: str) -> DataFrame:
    """``pairs`` of a table that holds both sources' fields in one row, the right ones with a prefix; nothing is joined."""
    told = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("left"), F.col(f"{prefix}{f}").alias("right")) for f in fields])
    return rows.where("class_name is not null").select("class_name", "sample_id", F.inline(told))


def kappa(paired: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact share and Cohen's kappa; null where chance alone agrees fully.

    Everything comes from one table of transition counts, which is small.
    """
    t = ready(paired.groupBy(*by, "left", "right").agg(F.count("*").alias("n")))  # asked for three times
    total = t.groupBy(*by).agg(F.sum("n").cast("double").alias("total"), F.sum(F.when(F.col("left") == F.col("right"), F.col("n")).otherwise(0)).alias("same"))
    a = t.groupBy(*by, F.col("left").alias("v")).agg(F.sum("n").alias("a"))
    b = t.groupBy(*by, F.col("right").alias("v")).agg(F.sum("n").alias("b"))
    chance = a.join(b, [*by, "v"]).groupBy(*by).agg(F.sum(F.col("a").cast("double") * F.col("b")).alias("ab"))
    j = total.join(chance, list(by), "left").withColumn("exact", F.col("same") / F.col("total")).withColumn("chance", F.coalesce("ab", F.lit(0.0)) / (F.col("total") * F.col("total")))
    return j.select(*by, "exact", F.try_divide(F.col("exact") - F.col("chance"), 1 - F.col("chance")).alias("kappa"))


ARMS = ("old", "revised")


def _draw(*parts: Column | str) -> Column:
    """Uniform in (0, 1) from a hash, the same in every engine."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def protocol_delta(old: DataFrame, revised: DataFrame, by: str, replicates: int = 2000) -> DataFrame:
    """Agreement under an old and a revised protocol, their differences in points and a decision.

    ``old`` and ``revised`` are tables of ``pairs``.  A target of one arm only is
    left out; see ``paired_delta``.
    """
    key = ["class_name", "sample_id", "field"]
    j = old.select(*key, F.col("left").alias("ol"), F.col("right").alias("or_")).join(revised.select(*key, F.col("left").alias("rl"), F.col("right").alias("rr")), key)
    return paired_delta(j.withColumn("n", F.lit(1)), by, replicates)


def paired_delta(both: DataFrame, by: str, replicates: int = 2000) -> DataFrame:
    """``protocol_delta`` of rows with the values of both arms, left and right (ol, or_, rl, rr), and how many pairs a row stands for (n).

    A share without a known pair is null.  All figures depend on the rows
    through at most 16 counts of outcomes for each value of ``by``, so rows are
    aggregated once and the bootstrap redraws counts: Poisson by its normal
    approximation, from a hash.  Its cost doesn't grow with the rows.
    """
    known = lambda a, b: (F.col(a) != "unknown") & (F.col(b) != "unknown")
    flags = {"old_same": F.col("ol") == F.col("or_"), "old_both": known("ol", "or_"), "revised_same": F.col("rl") == F.col("rr"), "revised_both": known("rl", "rr")}
    cells = both.groupBy(by, *[c.cast("int").alias(name) for name, c in flags.items()]).agg(F.sum("n").alias("n"))

    cell = F.concat("old_same", "old_both", "revised_same", "revised_both")
    rep = cells.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    z = F.sqrt(-2 * F.log(_draw(F.lit("r"), "rep", by, cell))) * F.cos(6.283185307179586 * _draw(F.lit("a"), "rep", by, cell))
    n = F.when(F.col("rep") == 0, F.col("n").cast("double")).otherwise(F.greatest(F.lit(0.0), F.round(F.col("n") + F.sqrt("n") * z)))
    rep = rep.withColumn("n", n)
    sums = [F.sum("n").alias("total")]
    for arm in ARMS:
        both = F.col(f"{arm}_both") == 1
        sums += [F.sum(F.when(both, F.col("n")).otherwise(0.0)).alias(f"{arm}_known"), F.sum(F.when(both & (F.col(f"{arm}_same") == 1), F.col("n")).otherwise(0.0)).alias(f"{arm}_hits"), F.sum(F.when(F.col(f"{arm}_same") == 1, F.col("n")).otherwise(0.0)).alias(f"{arm}_equal")]
    s = rep.groupBy(by, "rep").agg(*sums)
    for arm in ARMS:
        s = s.withColumn(f"{arm}_exact_pct", F.try_divide(100 * F.col(f"{arm}_equal"), "total")).withColumn(f"{arm}_both_known_pct", F.try_divide(100 * F.col(f"{arm}_known"), "total")).withColumn(f"{arm}_agreement_pct", F.try_divide(100 * F.col(f"{arm}_hits"), f"{arm}_known"))
    names = ("exact_pct", "both_known_pct", "agreement_pct")
    for c in names:
        s = s.withColumn(f"{c}_delta", F.col(f"revised_{c}") - F.col(f"old_{c}"))
    kept = ["old_known", *[f"{arm}_{c}" for arm in ARMS for c in names], *[f"{c}_delta" for c in names]]
    out = s.groupBy(by).agg(
        F.sum(F.when(F.col("rep") == 0, F.col("total"))).cast("long").alias("n"),
        *[F.max(F.when(F.col("rep") == 0, F.col(c))).alias(c) for c in kept],
        F.percentile(F.when(F.col("rep") > 0, F.col("agreement_pct_delta")), 0.025).alias("agreement_low"),
        F.percentile(F.when(F.col("rep") > 0, F.col("agreement_pct_delta")), 0.975).alias("agreement_high"),
    )
    failed = F.col("agreement_pct_delta").isNull() | (F.col("both_known_pct_delta") < -5) | (F.col("agreement_pct_delta") < 5)
    decision = (
        F.when(F.col("old_known") < 30, "insufficient_known_support")
        .when(F.col("old_agreement_pct") >= 95, "near_ceiling_descriptive_only")
        .when(failed, "screen_not_passed")
        .when(F.col("agreement_low") <= 0, "point_gate_passed_uncertain_direction")
        .otherwise("promising_for_expansion")
    )
    return out.withColumn("decision", decision).withColumn("old_known", F.col("old_known").cast("long"))
