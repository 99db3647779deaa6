"""Ranks, tiers, batches and prefixes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.sources.shared import ready


def null_safe_join(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; a null in ``by`` equals a null."""
    r = right.withColumnsRenamed({c: f"_join_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_join_{c}"))
    return left.join(r, same, how).drop(*[f"_join_{c}" for c in by])


def running(df: DataFrame, by: Sequence[str], keys: Sequence[str], amount: str, name: str, total: str) -> DataFrame:
    """The sum of ``amount`` over the rows of a group that come before in the order of ``keys``, and over the whole group; no group is sorted in one task.

    Rows are dealt to tasks by ranges of (by, keys).  What comes before a row
    is what comes before it in its range plus the sums of its group in the ranges
    before, of which there are no more than ranges and groups.  The ranges are
    written once, since they are drawn from a sample and are read twice.
    """
    d = ready(df.repartitionByRange(*by, *keys).withColumn("_range", F.spark_partition_id()))
    n = d.groupBy(*by, "_range").agg(F.sum(amount).alias("_k"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_k").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*by, "_range", before.alias("_before"), F.sum("_k").over(group).alias(total))
    local = F.coalesce(F.sum(amount).over(Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = null_safe_join(d.withColumn(name, local), n, [*by, "_range"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def average_rank(df: DataFrame, value: str, by: Sequence[str], name: str = "rank", count: str | None = None) -> DataFrame:
    """Rank with ties averaged; a null value has no rank and counts for none, a null in ``by`` is a group; a row stands for ``count`` rows.

    Equal values are counted before they are ranked, so what is ordered, by
    ranges, is one row for each distinct value.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(count) if count else F.count("*")).alias("_k"))
    ranks = running(n, by, [value], "_k", "_b", "_all").select(*by, value, (F.col("_b") + (F.col("_k") + 1) / 2).alias(name))
    return null_safe_join(df, ranks, [*by, value], "left")


def ranked(df: DataFrame, by: Sequence[str], *order: str | Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """Rank from 1 in the given order, and the number of rows of the group as ``total``; a null in ``by`` is a group, and no group is sorted in one task."""
    keys = [f"_o{i}" for i in range(len(order))]
    d = df.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys, strict=True)], F.lit(1).alias("_one"))
    out = running(d, by, keys, "_one", "_b", "_all").withColumn(name, (F.col("_b") + 1).cast("int"))
    out = out.withColumn(total, F.col("_all")) if total else out
    return out.select(*df.columns, name, *([total] if total else []))


#: Distinct scores of all groups up to which tiers are found from counts.
FEW = 20_000


def _tier(r: Column, n: int) -> Column:
    """Tier of rank ``r`` among _n rows in ``n`` near-equal parts, the longer first."""
    short, long = F.expr(f"_n div {n}"), F.col("_n") % n
    head = long * (short + 1)
    return (F.when(r <= head, F.floor((r - 1) / (short + 1))).otherwise(long + F.floor((r - 1 - head) / F.greatest(short, F.lit(1)))) + 1).cast("int")


#: Rows of all cut scores among which the keys at the limits are looked up; characters by which keys are told apart further in each pass before that.
NEAR, STEP = 100_000, 4


def _cut_keys(df: DataFrame, cut: DataFrame, by: Sequence[str], score: str, key: str, n: int) -> DataFrame | None:
    """by, score, _keys: the last key of each tier that ends within a cut score, sorted; None if keys are equal there.

    Keys are counted by their first characters, then those of the part in which
    a limit lies by some more, until few rows are left to look at: rows are read
    some times, but none is moved.  ``cut`` has rows (_k), rows before (_under)
    and rows of the group (_n) of each cut score.
    """
    group = [*by, score]
    last = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda t: t * F.expr(f"_n div {n}") + F.least(t, F.col("_n") % n) - F.col("_under"))
    at = cut.select(*group, F.explode(F.filter(last, lambda r: (r >= 1) & (r < F.col("_k")))).alias("_at"), "_k")
    start = lambda c, k: F.coalesce(F.substring(c, 1, k), F.lit(""))  # noqa: E731  # a null key comes first
    at, width = ready(at.withColumn("_p", F.lit(""))), 0
    while (at.where("_k > 1").select(*group, "_p", "_k").distinct().agg(F.sum("_k")).first()[0] or 0) > NEAR:
        part = F.broadcast(at.select(*group, "_p").distinct())  # n - 1 a score
        d = null_safe_join(df.select(*group, start(key, width).alias("_p"), F.col(key).alias("_name")), part, [*group, "_p"])
        width += STEP
        c = d.groupBy(*group, F.col("_p").alias("_of"), start("_name", width).alias("_p")).agg(F.count("*").alias("_k"), F.coalesce(F.max(F.length("_name")), F.lit(0)).alias("_long"))
        before = Window.partitionBy(*group, "_of").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        c = c.withColumn("_b", F.coalesce(F.sum("_k").over(before), F.lit(0)))
        j = null_safe_join(c, F.broadcast(at.select(*group, F.col("_p").alias("_of"), "_at")), [*group, "_of"])
        at = ready(j.where("_at > _b and _at <= _b + _k").select(*group, "_p", F.col("_k"), "_long", (F.col("_at") - F.col("_b")).alias("_at")))
        if not at.where(f"_k > 1 and _long <= {width}").isEmpty():
            return None
    part = F.broadcast(at.select(*group, "_p").distinct())
    near = null_safe_join(df.select(*group, start(key, width).alias("_p"), F.col(key).alias("_name")), part, [*group, "_p"])
    w = Window.partitionBy(*group, "_p").orderBy("_name")
    near = near.withColumn("_at", F.row_number().over(w).cast("long")).withColumn("_next", F.lead("_name").over(w))
    found = ready(null_safe_join(near, F.broadcast(at.select(*group, "_p", "_at")), [*group, "_p", "_at"]))
    if not found.where(F.col("_name").isNull() | F.coalesce(F.col("_name") == F.col("_next"), F.lit(False))).isEmpty():
        return None
    return found.groupBy(*group).agg(F.array_sort(F.collect_list("_name")).alias("_keys"))


def five_tiers(df: DataFrame, score: str, key: str, by: Sequence[str], n: int = 5, counts: DataFrame | None = None) -> DataFrame:
    """Near-equal parts in the order of (score, key); the longer parts come first.

    Scores are counted first (``counts``: by, score and rows as _k, if known).  If
    few are distinct, one that lies within a tier gives it to all its rows, and
    for a score that a limit cuts the keys at its limits are looked up; where
    keys are equal or no strings, the rows of such a score are ranked.  If many
    are distinct, all rows are ranked.
    """
    counts = ready(df.groupBy(*by, score).agg(F.count("*").alias("_k")) if counts is None else counts.groupBy(*by, score).agg(F.sum("_k").alias("_k")))
    if counts.count() > FEW:
        d = ranked(df, by, score, key, name="_r", total="_n")
        return d.withColumn("tier", _tier(F.col("_r"), n)).drop("_r", "_n")
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_k").over(group.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_under", before).withColumn("_n", F.sum("_k").over(group))
    first, last = _tier(F.col("_under") + 1, n), _tier(F.col("_under") + F.col("_k"), n)
    counts = ready(counts.withColumn("_first", first).withColumn("_tier", F.when(first == last, first)))
    out = [*df.columns, F.col("_tier").alias("tier")]
    if dict(df.dtypes)[key] == "string":
        keys = _cut_keys(df, counts.where("_tier is null"), by, score, key, n)
        if keys is not None:
            limits = null_safe_join(counts.select(*by, score, "_first"), keys, [*by, score], "left")
            j = null_safe_join(df, F.broadcast(limits), [*by, score])  # FEW rows
            above = F.coalesce(F.size(F.filter("_keys", lambda k: F.col(key) > k)), F.lit(0))
            return j.withColumn("_tier", F.col("_first") + F.when(F.col("_keys").isNull(), 0).otherwise(above)).select(*out)
    counts = counts.drop("_k", "_first")
    whole = null_safe_join(df, F.broadcast(counts.where("_tier is not null")), [*by, score])  # FEW rows
    cut = ready(null_safe_join(df, F.broadcast(counts.where("_tier is null")), [*by, score]))  # n scores a group
    cut = ranked(cut, [*by, score], key, name="_r").withColumn("_tier", _tier(F.col("_under") + F.col("_r"), n))
    return whole.select(*out).unionByName(cut.select(*out))


def tiers_floor(df: DataFrame, score: str, key: str, by: Sequence[str], n: int = 5) -> DataFrame:
    """floor(rank * n / rows) + 1: the same sizes, with the short parts elsewhere."""
    d = ranked(df, by, score, key, name="_r", total="_n")
    return d.withColumn("tier", (F.floor((F.col("_r") - 1) * n / F.col("_n")) + 1).cast("int")).drop("_r", "_n")


def hash_order(df: DataFrame, by: Sequence[str], *parts: str | Column, name: str = "rank") -> DataFrame:
    """Rank in the order of sha256 over the joined parts.

    For the first few of each group: a limit on the rank reaches the tasks
    before the shuffle.  All ranks of large groups: ``ranked`` over the hash.
    """
    key = F.sha2(F.concat_ws(":", *parts), 256)
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key)))


def hash_first(df: DataFrame, by: Sequence[str], k: int, *parts: str | Column, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``hash_order`` with their rank, checkpointed; few rows are sorted, whatever the group.

    Hashes are even, so nearly surely the first k of n are among those below
    (2 k + 100) / n of the range; only these are ranked.  A group in which they
    are too few is ranked whole.  Groups are few: each is a row that all tasks get.
    """
    n = ready(df.groupBy(*by).agg(F.count("*").alias("_n")))
    key = F.sha2(F.concat_ws(":", *parts), 256)
    told = df.withColumn("_h", key)
    below = told.transform(lambda d: null_safe_join(d, F.broadcast(n), by)).where(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") < F.lit(2.0**32) * (2 * k + 100) / F.col("_n"))
    near = ready(below.drop("_n"))
    have = near.groupBy(*by).agg(F.count("*").alias("_have"))
    short = null_safe_join(n, have, by, "left").where(F.coalesce("_have", F.lit(0)) < F.least("_n", F.lit(k))).select(*by)
    short = ready(short)
    if not short.isEmpty():
        short = short.withColumn("_short", F.lit(True))
        whole = null_safe_join(told, F.broadcast(short), by).drop("_short")
        near = null_safe_join(near, F.broadcast(short), by, "left").where("_short is null").drop("_short").unionByName(whole)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
    return ready(near.withColumn(name, rank).where(F.col(name) <= k).drop("_h"))


#: Leading hexadecimal digits of a hash that are counted before rows are ranked.
DIGITS = 3


def _digits(df: DataFrame, by: Sequence[str], parts: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """df with its hash _h and its leading digits _d; for each group and _d: rows, rows before, rows of the group (16 ** DIGITS a group at most)."""
    d = df.withColumn("_h", F.unhex(F.sha2(F.concat_ws(":", *parts), 256))).withColumn("_d", F.hex(F.substring("_h", 1, 2)).substr(1, DIGITS))
    group = Window.partitionBy(*by)
    n = d.groupBy(*by, "_d").agg(F.count("*").alias("_k"))
    before = F.coalesce(F.sum("_k").over(group.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d, ready(n.select(*by, "_d", "_k", before.alias("_before"), F.sum("_k").over(group).alias("_n")))


def hash_ranked(df: DataFrame, by: Sequence[str], key: str, *parts: str | Column, name: str = "rank") -> DataFrame:
    """All ranks in the order of (sha256 of the joined parts, key): counts of leading digits first, then ranks inside equal digits; rows move once."""
    d, n = _digits(df, by, parts)
    local = F.row_number().over(Window.partitionBy(*by, "_d").orderBy("_h", key))
    out = null_safe_join(d.withColumn("_r", local), F.broadcast(n), [*by, "_d"])  # groups x digits
    return out.withColumn(name, (F.col("_r") + F.col("_before")).cast("int")).select(*df.columns, name)


def hash_tiers(df: DataFrame, by: Sequence[str], key: str, *parts: str | Column, n: int = 5) -> DataFrame:
    """``five_tiers`` in the order of (sha256 of the joined parts, key): rows whose leading digits lie within one tier aren't moved or ranked."""
    d, counts = _digits(df, by, parts)
    tier = lambda r: _tier(r, n)
    first, last = tier(F.col("_before") + 1), tier(F.col("_before") + F.col("_k"))
    counts = ready(counts.withColumn("_tier", F.when(first == last, first)))
    j = null_safe_join(d, F.broadcast(counts), [*by, "_d"])  # groups x digits
    whole = j.where("_tier is not null").select(*df.columns, F.col("_tier").alias("tier"))
    cut = j.where("_tier is null").withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_d").orderBy("_h", key)))
    return whole.unionByName(cut.select(*df.columns, tier(F.col("_before") + F.col("_r")).alias("tier")))


def top_two(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Share of the two last places: 1 above the second largest, the rest split evenly at a tie."""
    w = Window.partitionBy(*by)
    second = F.nth_value(value, 2).over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = df.withColumn("_s", second)
    above = F.sum((F.col(value) > F.col("_s")).cast("int")).over(w)
    tied = F.sum((F.col(value) == F.col("_s")).cast("int")).over(w)
    return d.withColumn("share", F.when(F.col(value) > F.col("_s"), 1.0).when(F.col(value) == F.col("_s"), (2 - above) / tied).otherwise(0.0)).drop("_s")


def curve_area(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Trapezoids from (0, 0), divided by the last x."""
    w = Window.partitionBy(*by).orderBy(x)
    part = (F.col(x) - F.lag(x, 1, 0).over(w)) * (F.col(y) + F.lag(y, 1, 0.0).over(w)) / 2
    return df.withColumn("_a", part).groupBy(*by).agg((F.sum("_a") / F.max(x)).alias("area"))
