"""K-means of many groups and many starts at once.

All groups and all starts go together: one pass over the rows serves the next
seed, or the next step of Lloyd's rule, of every (group, start) that still moves.
Tasks add up their rows, Spark adds up the tasks; the driver holds the centres,
groups x starts x k vectors, so groups must be few (classes of a dictionary).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.sources.shared import ready

#: Starts of which the best counts, steps of one start at most, and the shift, in shares of the mean variance, at which it has settled.
STARTS, STEPS, SHIFT = 20, 300, 1e-4

Centres = dict[tuple[str, int], np.ndarray]


def _uniform(ids: np.ndarray, *parts: int) -> np.ndarray:
    """A number between 0 and 1 for each id, the same on every cluster."""
    x = ids.astype(np.uint64)
    for p in (*parts, 1):
        x = (x + np.uint64(p) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def _distances(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for b in batches:
        for name, g in b.groupby("group", sort=False):
            yield name, g["id"].to_numpy(), np.array(g["v"].tolist(), float)


def _next_seeds(rows: DataFrame, centres: Centres, wanted: list[tuple[str, int]], turn: int) -> Centres:
    """One more seed for each of ``wanted``, drawn by the squared distance to the seeds so far: the least exponential number of that rate."""
    sent = rows.sparkSession.sparkContext.broadcast((centres, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, wanted = sent.value
        best: dict[tuple[str, int], tuple] = {}
        for name, ids, v in _by_group(batches):
            for key in wanted:
                if key[0] == name:
                    rate = _distances(v, centres[key]).min(axis=1) if key in centres else np.ones(len(v))
                    with np.errstate(divide="ignore"):
                        wait = np.where(rate > 1e-12, -np.log(_uniform(ids, key[1], turn)) / rate, np.inf)
                    i = int(np.lexsort((ids, wait))[0])
                    if np.isfinite(wait[i]):
                        best[key] = min(best.get(key, (np.inf, 0, None)), (float(wait[i]), int(ids[i]), v[i].tolist()), key=lambda x: x[:2])
        yield pd.DataFrame([(*k, *x) for k, x in best.items()], columns=["group", "start", "wait", "id", "v"])

    kind = rows.schema["group"].dataType.simpleString()
    found = rows.mapInPandas(run, f"`group` {kind}, start int, wait double, id long, v array<double>")
    chosen = found.groupBy("group", "start").agg(F.min(F.struct("wait", "id", "v")).alias("s")).select("group", "start", "s.v").collect()  # groups x starts
    return {(r.group, r.start): np.vstack([*([centres[r.group, r.start]] if (r.group, r.start) in centres else []), np.array(r.v)[None, :]]) for r in chosen}


def _sums(rows: DataFrame, centres: Centres, width: int) -> dict[tuple[str, int], tuple[float, np.ndarray, np.ndarray]]:
    """(inertia, counts, sums) of each (group, start) under its centres."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, out = sent.value, {}
        for name, _, v in _by_group(batches):
            for key, c in centres.items():
                if key[0] == name:
                    d = _distances(v, c)
                    near = d.argmin(axis=1)
                    hot = np.zeros((len(v), len(c)))
                    hot[np.arange(len(v)), near] = 1.0
                    part = np.hstack([(hot * d).sum(axis=0)[:, None], hot.sum(axis=0)[:, None], hot.T @ v])
                    out[key] = out.get(key, 0.0) + part
        yield pd.DataFrame([(*key, j, *row) for key, part in out.items() for j, row in enumerate(part.tolist())], columns=["group", "start", "centre", "inertia", "n", *[f"s{i}" for i in range(width)]])

    kind = rows.schema["group"].dataType.simpleString()
    names = ["inertia", "n", *[f"s{i}" for i in range(width)]]
    found = rows.mapInPandas(run, f"`group` {kind}, start int, centre int, " + ", ".join(f"{c} double" for c in names))
    totals = found.groupBy("group", "start", "centre").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # groups x starts x k
    out = {}
    for key, g in totals.groupby(["group", "start"]):
        g = g.sort_values("centre")
        out[key[0], int(key[1])] = (float(g["inertia"].sum()), g["n"].to_numpy(), g[names[2:]].to_numpy())
    return out


def fit(rows: DataFrame, k: Mapping[str, int], starts: int = STARTS, steps: int = STEPS) -> tuple[Centres, dict[tuple[str, int], float]]:
    """Centres and inertia of each (group, start) of ``rows`` (group, id long, v array<double>), with k centres a group.

    Seeds are drawn as in k-means++.  A start depends on its number alone, so
    more starts never make the best one worse.  A group of fewer distinct rows
    than k has as many centres as rows; a centre that loses all rows stays.
    """
    width = rows.select(F.size("v")).first()[0]
    centres: Centres = {}
    for turn in range(max(k.values())):
        wanted = [(g, s) for g, n in k.items() for s in range(starts) if turn < n and (turn == 0 or (g, s) in centres and len(centres[g, s]) == turn)]
        centres |= _next_seeds(rows, centres, wanted, turn)
    spread = {r["group"]: r["total"] / width for r in rows.groupBy("group").agg(F.count("*").alias("n"), *[F.var_pop(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).select("group", sum(F.col(f"v{i}") for i in range(width)).alias("total")).collect()}
    inertia: dict[tuple[str, int], float] = {}
    moving = dict(centres)
    for _ in range(steps):
        if not moving:
            break
        still: Centres = {}
        for key, (total, n, sums) in _sums(rows, moving, width).items():
            old = moving[key]
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], old)
            inertia[key], centres[key] = total, new
            if ((new - old) ** 2).sum() > SHIFT * spread[key[0]]:
                still[key] = new
        moving = still
    # the last step moved the centres once more
    inertia |= {key: total for key, (total, _, _) in _sums(rows, centres, width).items()}
    return centres, inertia


def assign(rows: DataFrame, centres: Mapping[str, np.ndarray]) -> DataFrame:
    """group, id, cluster: the nearest of the group's centres, the first at a tie."""
    sent = rows.sparkSession.sparkContext.broadcast(dict(centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, ids, v in _by_group(batches):
            yield pd.DataFrame({"group": name, "id": ids, "cluster": _distances(v, sent.value[name]).argmin(axis=1)})

    kind = rows.schema["group"].dataType.simpleString()
    return rows.mapInPandas(run, f"`group` {kind}, id long, cluster int")


def clusters(rows: DataFrame, most: int = 8, starts: int = STARTS) -> DataFrame:
    """group, id, cluster of ``rows`` (group, id, v): k = clamp(round(sqrt n), 2, ``most``), at most n; of ``starts`` starts the one of least inertia.

    Vectors are scaled to length 1 and of equal width; rows with a null group, id
    or vector take no part; an empty table gives an empty result.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    unit = F.transform("v", lambda x: x / F.greatest(norm, F.lit(1e-12)))
    rows = ready(rows.where("`group` is not null and id is not null and v is not null").select("group", F.col("id").cast("long").alias("id"), unit.alias("v")))
    sizes = {r["group"]: r["n"] for r in rows.groupBy("group").agg(F.count("*").alias("n")).collect()}  # the groups are few
    if not sizes:
        return rows.select("group", "id", F.lit(0).alias("cluster"))
    centres, inertia = fit(rows, {g: min(n, max(2, min(most, round(n**0.5)))) for g, n in sizes.items()}, starts)
    best = {g: centres[min((key for key in inertia if key[0] == g), key=lambda key: (inertia[key], key[1]))] for g in sizes}
    return assign(rows, best)
