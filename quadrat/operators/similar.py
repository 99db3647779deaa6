"""Similarity, near duplicates and graphs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.functions import scalar as S
from quadrat.sources.shared import ready


#: Band layouts: number of bands of a hash, and below how many hashes it is the cheapest for a distance around 8 of 64 bits.
LAYOUTS = ((3, 2_000_000), (2, None))


def layout(n: int, distance: int, bits: int = 64) -> int:
    """Number of bands for ``n`` hashes: wider bands, with more flips, as the hashes grow in number.

    A band of w bits in which e may differ meets about n * C(w, <= e) / 2**w
    strangers a hash, so w follows log2 n: 21 bits below two million hashes, 32
    from there, which keeps a hash's candidates at a few hundred up to 10**7.
    """
    count = next(b for b, most in LAYOUTS if most is None or n < most)
    return max(1, min(count, distance + 1, bits // 2))


def variants(part_bits: Sequence[tuple[int, int]], flips: int) -> str:
    """SQL of an array of (part, low, width, mask, n, least, most): each part as it is and with up to ``flips`` of its bits flipped."""
    rows = []
    for part, (low, width) in enumerate(part_bits):
        for n in range(flips + 1):
            for at in combinations(range(width), n):
                rows.append(f"({part}, {low}, {(1 << width) - 1}L, {sum(1 << i for i in at)}L, {n}, {min(at, default=-1)}, {max(at, default=-1)})")
    return f"array({','.join(f'struct{r}' for r in rows)})"


def banded(hashes: DataFrame, hash_: str, side: str, n: int, flips: int, bits: int = 64) -> DataFrame:
    """hash, part, bits, and of the flipped bits their number and edges, a row for each part and each way to flip up to ``flips`` of its bits."""
    cuts = [(i * bits // n, (i + 1) * bits // n) for i in range(n)]
    d = hashes.select(F.col(hash_).alias(f"h{side}"), F.expr(f"inline({variants([(lo, hi - lo) for lo, hi in cuts], flips)})").alias("part", "_low", "_mask", "_flip", f"n{side}", f"least{side}", f"most{side}"))
    value = F.expr(f"shiftrightunsigned(h{side}, _low)").bitwiseAND(F.col("_mask")).bitwiseXOR(F.col("_flip"))
    return d.select(f"h{side}", "part", value.alias("bits"), f"n{side}", f"least{side}", f"most{side}")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_classes(table: DataFrame, key: str, hash_: str, distance: int) -> tuple[DataFrame, DataFrame]:
    """(members, links): key and class (the smallest key with an equal hash); a, b, distance between classes.

    A group of copies is one class, so m copies cost m rows and no pairs.
    """
    classes = table.groupBy(F.col(hash_).alias("h")).agg(F.min(key).alias("class"))
    members = table.select(F.col(key), F.col(hash_).alias("h")).join(classes, "h").select(key, "class")
    return members, hamming_pairs(classes, None, "class", "h", distance)


def hamming_pairs(left: DataFrame, right: DataFrame | None, key: str, hash_: str, distance: int, bands: int | None = None) -> DataFrame:
    """(a, b, distance) of hashes at most ``distance`` bits apart; by bands, without a cross join.

    Of ``bands`` bands one has at most e = distance // bands differing bits.  One
    side lists its bands with up to half of e bits flipped, the other with the
    rest, so these meet, and in one way only: the first side flips the lower of
    the differing bits and as many as it may, the second what is left.  The
    number of bands follows the number of hashes (``layout``).

    Equal hashes are one row while pairs are sought, so a group of copies costs
    one row a band; its members are joined back at the end.  With one table,
    a < b, and only the smaller hash looks for the larger.  The distinct hashes
    and the pairs of hashes are checkpointed.
    """
    same = right is None
    right = left if same else right
    # written once: what hashes are made of is read and planned once, not for each side, the count and the members
    hashes = lambda t: ready(t.select(F.col(hash_).alias("h")).where("h is not null").distinct())
    lh = hashes(left)
    rh = lh if same else hashes(right)
    n = bands or layout(rh.count(), distance)
    errors = distance // n
    first, second = (errors + 1) // 2, errors // 2
    a, b = banded(lh, "h", "a", n, first), banded(rh, "h", "b", n, second)
    once = (F.col("nb") == 0) | ((F.col("na") == first) & (F.col("mosta") < F.col("leastb")))
    meet = ["part", "bits"]
    ordered = (F.col("ha") <= F.col("hb")) if same else F.lit(True)
    # a band row for each flip: what the optimizer takes for the size of the hashes is many times that, so never sent whole
    near = a.join(b.hint("merge"), meet).where(once & ordered & (hamming(F.col("ha"), F.col("hb")) <= distance)).select("ha", "hb").distinct()
    near = ready(near.withColumn("distance", hamming(F.col("ha"), F.col("hb"))))
    out = near.join(left.select(F.col(key).alias("a"), F.col(hash_).alias("ha")), "ha").join(right.select(F.col(key).alias("b"), F.col(hash_).alias("hb")), "hb")
    if not same:
        return out.select("a", "b", "distance")
    # hashes were ordered, not their keys; within a group of copies the keys are
    out = out.where((F.col("ha") != F.col("hb")) | (F.col("a") < F.col("b")))
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")


def confirmed(pairs: DataFrame, vectors: DataFrame, key: str, v: str, rules: Sequence[tuple[int, float]] = ((4, 0.98), (8, 0.995))) -> DataFrame:
    """Pairs that pass a joint rule on distance and cosine."""
    x, y = vectors.select(F.col(key).alias("a"), F.col(v).alias("va")), vectors.select(F.col(key).alias("b"), F.col(v).alias("vb"))
    j = pairs.join(x, "a").join(y, "b").withColumn("cosine", S.cosine(F.col("va"), F.col("vb")))
    ok = F.lit(False)
    for d, c in rules:
        ok = ok | ((F.col("distance") <= d) & (F.col("cosine") >= c))
    return j.where(ok).select("a", "b", "distance", "cosine")


#: Numbers in the table of cosines that a task holds at once.
TABLE = 2_000_000


def nearest(queries: DataFrame, pool: DataFrame, key: str, v: str, k: int, block: int = 20_000, groups: tuple[str, str, bool] | None = None) -> DataFrame:
    """The k nearest of ``pool`` to each query by cosine; a query itself isn't one of them.

    Queries go in blocks of about ``block`` to all tasks (a few megabytes) and a
    block reads the pool once.  A task multiplies its rows, some at a time, with
    the queries and keeps the k best of each, so k rows a task and query are
    ranked at the end.  ``groups`` (query column, pool column, same): only rows
    whose group equals that of the query, or differs from it, are looked at; a null
    group neither equals nor differs.
    """
    of_query, of_row, same = groups or (None, None, True)
    spark, kind = queries.sparkSession, queries.schema[key].dataType.simpleString()
    asked = queries.select(F.col(key).alias("id"), F.col(v).alias("v"), (F.col(of_query) if of_query else F.lit(0)).alias("g")).where("g is not null")
    rows = pool.select(F.col(key).alias("id"), F.col(v).alias("v"), (F.col(of_row) if of_row else F.lit(0)).alias("g")).where("g is not null")
    n = max(1, -(-asked.count() // block))

    def unit(vectors) -> np.ndarray:
        x = np.array(vectors.tolist(), float)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    out = None
    for i in range(n):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toPandas()  # about ``block`` rows
        sent = spark.sparkContext.broadcast((mine["id"].to_numpy(), unit(mine["v"]) if len(mine) else np.empty((0, 1)), mine["g"].to_numpy()))

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, units, own = sent.value
            if not len(ids):
                return
            best, names = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), ids.dtype)
            step = max(k, TABLE // max(1, len(ids)))
            for b in (big.iloc[at : at + step] for big in batches for at in range(0, len(big), step)):
                there, group = b["id"].to_numpy(), b["g"].to_numpy()
                near = np.round(units @ unit(b["v"]).T, 9)
                near[(ids[:, None] == there[None, :]) | ((own[:, None] == group[None, :]) != same) | np.isnan(near)] = -np.inf
                near, every = np.hstack([best, near]), np.hstack([names, np.broadcast_to(there, near.shape)])
                order = np.lexsort((every, -near), axis=1)[:, :k]
                best, names = np.take_along_axis(near, order, 1), np.take_along_axis(every, order, 1)
            q, j = np.nonzero(best > -np.inf)
            yield pd.DataFrame({"q": ids[q], "id": names[q, j], "cosine": best[q, j]})

        found = rows.mapInPandas(search, f"q {kind}, id {kind}, cosine double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def components(edges: DataFrame) -> DataFrame:
    """node, root: connected components, root = smallest node; large-star and small-star steps until nothing changes."""
    e = ready(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        e = ready(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
