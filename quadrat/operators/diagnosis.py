"""Where classifiers fail: conditional gaps and their confirmation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def condition_gaps(recalls: DataFrame, run: Sequence[str], minimum: int = 20) -> DataFrame:
    """Recall with a state less recall of its known complement in the same field.

    The complement is the field's total less the state, so one aggregate and one
    window over states do; unknown values are never a control.
    """
    w = Window.partitionBy(*run, "class_name", "field")
    rest_n, rest_k = F.sum("n").over(w) - F.col("n"), F.sum("n_correct").over(w) - F.col("n_correct")
    g = recalls.withColumn("rest_n", rest_n).withColumn("rest_k", rest_k)
    gap = F.col("n_correct") / F.col("n") - F.try_divide(F.col("rest_k").cast("double"), F.col("rest_n"))
    return g.withColumn("gap", gap).withColumn("eligible", (F.col("n") >= minimum) & (F.col("rest_n") >= minimum))


def confirm(found: DataFrame, other: DataFrame, keys: Sequence[str], limit: float) -> DataFrame:
    """Each frozen condition on a second pool: confirmed, not_confirmed or insufficient."""
    o = other.select(*keys, F.col("gap").alias("gap2"), F.col("eligible").alias("eligible2"))
    j = found.join(o, list(keys), "left")
    status = F.when(F.coalesce("eligible2", F.lit(False)), F.when(F.col("gap2") <= limit, "confirmed").otherwise("not_confirmed")).otherwise("insufficient")
    return j.withColumn("status", status)


def decompose(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Difference of two methods' confirmed states in four exclusive parts."""
    a = left.select(*keys, F.col("eligible").alias("ea"), F.col("confirmed").alias("ca"))
    b = right.select(*keys, F.col("eligible").alias("eb"), F.col("confirmed").alias("cb"))
    j = a.join(b, list(keys), "full_outer").na.fill(False, ["ea", "ca", "eb", "cb"])
    both = F.col("ea") & F.col("eb")
    return j.agg(
        F.count_if(F.col("ca") & ~F.col("eb")).alias("only_left_eligible"),
        F.count_if(F.col("cb") & ~F.col("ea")).alias("only_right_eligible"),
        F.count_if(both & F.col("ca") & ~F.col("cb")).alias("left_gap"),
        F.count_if(both & F.col("cb") & ~F.col("ca")).alias("right_gap"),
        (F.count_if("ca") - F.count_if("cb")).alias("total"),
    )


def standardised_gaps(cells: DataFrame, keys: Sequence[str], minimum: int = 5, retained: float = 0.8) -> DataFrame:
    """cells: keys, tier, n1, k1 (with), n0, k0 (without).  Pooled, retained and tier-standardised gaps.

    A tier counts if both sides reach ``minimum``; the standardised gap weighs
    tiers by their members with the state.
    """
    keep = (F.col("n1") >= minimum) & (F.col("n0") >= minimum)
    on = lambda c: F.sum(F.when(keep, F.col(c)))
    gap = F.col("k1") / F.col("n1") - F.col("k0") / F.col("n0")
    g = cells.groupBy(*keys).agg(
        (F.sum("k1") / F.sum("n1") - F.try_divide(F.sum("k0").cast("double"), F.sum("n0"))).alias("pooled"),
        (on("k1") / on("n1") - on("k0") / on("n0")).alias("kept_gap"),
        (F.sum(F.when(keep, gap * F.col("n1"))) / on("n1")).alias("standardised"),
        (F.coalesce(on("n1"), F.lit(0)) / F.sum("n1")).alias("share_kept"),
    )
    return g.withColumn("eligible", F.col("share_kept") >= retained)


INTERACTION = "samples long, decisions long, estimable int, reason string, log_odds double, odds_ratio double, low double, high double, p_value double"


def interaction(df: DataFrame, error: str, a: str, b: str, factors: Sequence[str], cluster: str) -> DataFrame:
    """Does ``a`` add to ``b``: log-odds of a*b in error ~ a * b + factors, with errors clustered by ``cluster``.

    One row.  ``error``, ``a`` and ``b`` are 0/1 ints; rows with a null in any column
    used are left out.  Not estimable, with a reason, unless each of the four cells
    of (a, b) has rows with and without error, and the design has full rank.

    The fit reads a table of counts, one row for each pattern of the covariates,
    whose size is the product of their levels.  The variance is a sandwich: the
    bread from that table, the filling from sums of scores in each cluster, which
    Spark adds up.  The driver holds matrices of the size of the coefficients.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    spark = df.sparkSession
    d = df.select(error, a, b, *factors, cluster).na.drop()
    patterns = d.groupBy(a, b, *factors).agg(F.count("*").alias("_n"), F.sum(error).alias("_k"))
    counts = patterns.collect()  # one row for each pattern
    decisions = sum(r["_n"] for r in counts)

    def row(reason: str | None, *figures: float, samples: int | None = None) -> DataFrame:
        figures = figures or (None,) * 5
        samples = d.select(cluster).distinct().count() if samples is None else samples
        return spark.createDataFrame([(samples, decisions, int(reason is None), reason, *figures)], INTERACTION)

    for x in (0, 1):
        for y in (0, 1):
            cell = [r for r in counts if (r[a], r[b]) == (x, y)]
            n, k = sum(r["_n"] for r in cell), sum(r["_k"] for r in cell)
            if not 0 < k < n:
                return row("a cell has no row with or without error")

    terms: list[Column] = [F.lit(1.0), F.col(a).cast("double"), F.col(b).cast("double"), (F.col(a) * F.col(b)).cast("double")]
    for f in factors:
        terms += [(F.col(f) == level).cast("double") for level in sorted({r[f] for r in counts})[1:]]
    names = [f"_x{i}" for i in range(len(terms))]
    design = spark.createDataFrame(counts, patterns.schema).select("*", *[t.alias(x) for t, x in zip(terms, names, strict=True)])
    x = np.array([[r[c] for c in names] for r in design.collect()])
    if np.linalg.matrix_rank(x) < len(terms):
        return row("the design has not full rank")

    pick = VectorAssembler(inputCols=names[1:], outputCol="features").transform(design)
    rows = pick.select("features", F.lit(1.0).alias("y"), F.col("_k").alias("w")).unionByName(pick.select("features", F.lit(0.0).alias("y"), (F.col("_n") - F.col("_k")).alias("w"))).where("w > 0")
    fit = LogisticRegression(labelCol="y", weightCol="w", maxIter=500, tol=1e-12).fit(rows)
    beta = [float(fit.intercept), *map(float, fit.coefficients.toArray())]

    n = np.array([r["_n"] for r in counts], float)
    p = 1 / (1 + np.exp(-(x @ np.array(beta))))
    bread = np.linalg.inv((x * (n * p * (1 - p))[:, None]).T @ x)
    linear = sum((F.lit(float(c)) * t for c, t in zip(beta[1:], terms[1:], strict=True)), F.lit(float(beta[0])))
    residual = d.select(cluster, (F.col(error) - 1 / (1 + F.exp(-linear))).alias("_r"), *[t.alias(c) for t, c in zip(terms, names, strict=True)])
    scores = residual.groupBy(cluster).agg(*[F.sum(F.col(c) * F.col("_r")).alias(c) for c in names])
    at = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    sums = scores.agg(*[F.sum(F.col(names[i]) * F.col(names[j])) for i, j in at], F.count("*")).first()
    filling = np.zeros((len(names), len(names)))
    for (i, j), v in zip(at, sums[:-1], strict=True):
        filling[i, j] = filling[j, i] = v
    se = math.sqrt(float((bread @ filling @ bread)[3, 3]))
    effect = beta[3]
    p_value = math.erfc(abs(effect) / se / math.sqrt(2)) if se else None
    return row(None, effect, math.exp(effect), math.exp(effect - 1.959963984540054 * se), math.exp(effect + 1.959963984540054 * se), p_value, samples=sums[-1])
