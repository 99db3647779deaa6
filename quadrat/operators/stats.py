"""Statistics and resampling."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.operators.ranking import average_rank, null_safe_join, ranked
from quadrat.sources.shared import ready


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Rank correlation with averaged ties; null where a side is constant.

    Equal pairs of values are one row with a count, checkpointed, before anything is ranked.
    """
    n = ready(df.groupBy(*by, x, y).agg(F.count("*").alias("_n")))
    r = average_rank(average_rank(n, x, by, "_rx", "_n"), y, by, "_ry", "_n")
    # around the middle of all ranks, which keeps the sums small
    rows = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))
    middle = r.groupBy(*by).agg(((rows("_rx") + 1) / 2).alias("_mx"), ((rows("_ry") + 1) / 2).alias("_my"))
    r = null_safe_join(r, middle, by).withColumn("_dx", F.col("_rx") - F.col("_mx")).withColumn("_dy", F.col("_ry") - F.col("_my"))
    both = F.col("_dx").isNotNull() & F.col("_dy").isNotNull()
    mean = lambda v: F.sum(F.when(both, F.col("_n") * v)) / F.sum(F.when(both, F.col("_n")))
    spread = lambda c: F.sqrt(F.sum(F.col("_n") * F.col(c) * F.col(c)) / rows(c))
    a, b = F.col("_dx"), F.col("_dy")
    return r.groupBy(*by).agg(F.try_divide(mean(a * b) - mean(a) * mean(b), spread("_dx") * spread("_dy")).alias("rho"))


def error_auc(df: DataFrame, score: str, wrong: str, by: Sequence[str]) -> DataFrame:
    """Rank area under the curve with ties; null if a class is absent."""
    r = average_rank(df, score, by, "_r")
    n1, n0 = F.sum(wrong), F.sum(1 - F.col(wrong))
    return r.groupBy(*by).agg(F.try_divide(F.sum(F.col("_r") * F.col(wrong)) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def holm(df: DataFrame, p: str, by: Sequence[str], *ties: str) -> DataFrame:
    """Step-down adjusted p within families."""
    w = Window.partitionBy(*by)
    order = w.orderBy(p, *ties)
    stepped = F.least(F.lit(1.0), (F.count("*").over(w) - F.row_number().over(order) + 1) * F.col(p))
    d = df.withColumn("_s", stepped)
    return d.withColumn("adjusted", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def kendall(counts: DataFrame, x: str, y: str, n: str = "n") -> DataFrame:
    """tau-b from a table of (x, y, n): distinct values are joined, not rows."""
    a = counts.select(F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(n).alias("n1"))
    b = counts.select(F.col(x).alias("x2"), F.col(y).alias("y2"), F.col(n).alias("n2"))
    # ordered pairs of distinct x, found by a join on the smaller value; values are few by contract
    j = a.join(b, F.col("x1") < F.col("x2"))
    w = F.col("n1").cast("double") * F.col("n2")
    s = j.agg(F.sum(F.when(F.col("y1") < F.col("y2"), w).otherwise(0.0)).alias("c"), F.sum(F.when(F.col("y1") > F.col("y2"), w).otherwise(0.0)).alias("d"))
    pairs = lambda k: k.agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2))
    tx = pairs(counts.groupBy(x).agg(F.sum(n).alias("k"))).toDF("tx")
    ty = pairs(counts.groupBy(y).agg(F.sum(n).alias("k"))).toDF("ty")
    t = counts.agg(F.sum(n).cast("double").alias("t"))
    q = s.crossJoin(tx).crossJoin(ty).crossJoin(t)  # one row each
    n0 = F.col("t") * (F.col("t") - 1) / 2
    return q.select(F.try_divide(F.col("c") - F.col("d"), F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))).alias("tau"))


def sign_flips(df: DataFrame, value: str, k: int, by: Sequence[str]) -> DataFrame:
    """Exact two-sided p over all 2**k sign changes of k means (k small)."""
    g = df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias("_v"))
    g = g.withColumn("_f", F.explode(F.sequence(F.lit(0), F.lit(2**k - 1))))
    flipped = F.aggregate(F.transform("_v", lambda x, i: F.when(F.floor(F.col("_f") / F.pow(F.lit(2), i)) % 2 == 1, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x)
    plain = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    return g.groupBy(*by).agg(F.avg((F.abs(flipped) >= F.abs(plain) - 1e-12).cast("double")).alias("p"))


def poisson_weight(*parts: Column | str) -> Column:
    """Poisson(1) weight from a hash: the same on every cluster, no state, no draw kept."""
    u = F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / (1 << 30)
    out, total, term = F.lit(0), 0.0, 0.36787944117144233
    for k in range(8):
        total += term
        out = out + (u >= total).cast("int")
        term /= k + 1
    return out


#: Samples of one outcome up to which counts are drawn exactly; above it numpy has no hypergeometric draw and the normal approximation is used.
EXACT = 10**9 - 1


def _per_replicate(spark, replicates: int, columns: Sequence[str], draw) -> DataFrame:
    """A row (rep, *columns) for each replicate; its random numbers depend on its number alone, so they are the same on every cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.array([draw(np.random.Generator(np.random.Philox(key=int(r)))) for r in b["rep"]]).reshape(len(b), len(columns))
            yield pd.DataFrame(dict(zip(columns, got.T, strict=True))).assign(rep=b["rep"].to_numpy())

    reps = spark.range(1, replicates + 1).withColumnRenamed("id", "rep")
    return reps.mapInPandas(run, "rep long, " + ", ".join(f"`{c}` double" for c in columns)).select("rep", *columns)


def bootstrap_sums(outcomes: DataFrame, values: Sequence[str], count: str, replicates: int) -> DataFrame:
    """(rep, *values): weighted sums over all samples, each with a Poisson(1) weight of its own, in ``replicates`` draws.

    ``outcomes`` has one row for each distinct outcome and how many samples
    have it.  The weights of ``count`` equal samples add up to one
    Poisson(count) number, so a replicate costs a draw an outcome, not a sample.
    The outcomes go to the driver: how many there are must not depend on the rows.
    """
    rows = sorted(tuple(r) for r in outcomes.select(*values, count).collect())
    table = np.array(rows, dtype=float).reshape(len(rows), len(values) + 1)
    return _per_replicate(outcomes.sparkSession, replicates, list(values), lambda rng: rng.poisson(table[:, -1]) @ table[:, :-1])


def _taken(rng: np.random.Generator, counts: np.ndarray, size: int) -> np.ndarray:
    """How many of each outcome are among ``size`` samples drawn without replacement."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, n in enumerate(counts):
        n = int(n)
        if left <= EXACT:
            k = int(rng.hypergeometric(n, left - n, size)) if size else 0
        else:
            spread = (size / left) * (n / left) * (1 - n / left) * left * (1 - size / left) * left / (left - 1)
            k = min(max(round(rng.normal(size * (n / left), max(spread, 0.0) ** 0.5)), size - (left - n), 0), n, size)
        out[i], size, left = k, size - k, left - n
    return out


def random_tier_gaps(outcomes: DataFrame, by: str, value: str, count: str, replicates: int, n: int = 5) -> DataFrame:
    """(rep, d): mean of the last tier less that of the first in ``replicates`` random divisions of each group into n tiers.

    ``outcomes`` has one row (by, value, count) for each distinct value of a
    group.  Which samples of equal value enter a tier makes no difference, so
    their numbers are drawn (hypergeometric), not the samples.  Tier sizes are
    those of ntile.  The outcomes go to the driver: their number must not
    depend on the rows.
    """
    groups: dict = {}
    for g, v, k in sorted(tuple(r) for r in outcomes.select(by, value, count).collect()):
        groups.setdefault(g, []).append((float(v), int(k)))
    tables = [(np.array([v for v, _ in x]), np.array([k for _, k in x], dtype=np.int64)) for _, x in sorted(groups.items())]

    def draw(rng: np.random.Generator) -> float:
        sums, sizes = [0.0, 0.0], [0, 0]
        for v, k in tables:
            total = int(k.sum())
            size = (total // n, total // n + (total % n > 0))  # the last tier, the first
            last = _taken(rng, k, size[0])
            for i, part in enumerate((last, _taken(rng, k - last, size[1]))):
                sums[i] += float(part @ v)
                sizes[i] += size[i]
        return sums[0] / sizes[0] - sums[1] / sizes[1] if all(sizes) else np.nan

    return _per_replicate(outcomes.sparkSession, replicates, ["d"], draw)


def bootstrap_median(df: DataFrame, value: str, replicates: int) -> DataFrame:
    """rep, m: the median of ``value`` (rep 0) and of ``replicates`` samples of as many rows drawn with replacement.

    The rows are sorted once, by ranges, and none is copied.  The ranks of the
    middle rows of a sample are order statistics of as many uniform numbers, so a
    replicate draws one or two beta numbers and looks its ranks up: its cost
    doesn't depend on the rows.  Nulls take no part; no rows, no result.
    """
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = v.count()
    middle, spark = (n + 1) // 2, df.sparkSession

    def draw(rng: np.random.Generator) -> tuple[float, float]:
        low = rng.beta(middle, n - middle + 1)
        high = low if n % 2 else low + (1 - low) * rng.beta(1, n - middle)
        return max(1.0, np.ceil(n * low)), max(1.0, np.ceil(n * high))

    if not n:
        return spark.createDataFrame([], "rep long, m double")
    drawn = _per_replicate(spark, replicates, ["low", "high"], draw)
    whole = spark.createDataFrame([(0, float(middle), float(n // 2 + 1))], "rep long, low double, high double")
    wanted = drawn.unionByName(whole).select("rep", F.explode(F.array("low", "high").cast("array<bigint>")).alias("at"))
    ranks = ranked(v, [], "v", name="at")
    return ranks.join(F.broadcast(wanted), "at").groupBy("rep").agg(F.avg("v").alias("m"))  # two rows a replicate
