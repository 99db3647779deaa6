"""One control for each case, without replacement, at the least total cost.

Rows that are alike in block, group and size (to the width of ``grid``) are one
point with a count, so a block is a transport problem whose size is bounded by
the grid, however many rows it has.  Spark counts the points and deals the blocks
out; a block is solved by an auction with prices; then the rows of a point are
ranked, by ranges, and each looks up its partner.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.ranking import ranked
from quadrat.sources.shared import ready

#: Width of a step of the z-scored log size, and how far a pair's price may be from the best.
GRID, EPSILON = 0.01, 0.002
FLOWS = "case string, control string, m long, case_from long, control_from long, cost double, bound double"


class Auction:
    """Bidders with ``need`` units each for items with ``room`` units, at least as many in all.

    cost(i, items): what bidder i pays for a unit of each.  A bidder that lacks
    units takes the cheapest by cost plus price, from free units or from others,
    and raises what it holds to the level of the best unit it leaves, plus
    ``epsilon``.  Prices only rise, free units stay at 0, so at the end no unit
    could be had for ``epsilon`` less: the total is within ``epsilon`` a unit of
    the least, and ``bound`` proves it.  Every bid raises a price by ``epsilon`` at
    least and no price passes the largest cost by more, so bids are bounded by
    bidders x items x largest cost / epsilon.
    """

    def __init__(self, cost: Callable[[int, np.ndarray], np.ndarray], need: np.ndarray, room: np.ndarray, epsilon: float):
        m = len(room)
        self.cost = cost
        # lots: units of one item with one price and one owner (-1: free)
        self.item, self.price, self.units, self.owner = np.arange(m), np.zeros(m), room.astype(np.int64), np.full(m, -1)
        self._own: dict[tuple[int, int], int] = {}
        self._empty: list[int] = []
        lacks = need.astype(np.int64).copy()
        waiting = deque(np.flatnonzero(lacks).tolist())
        while waiting:
            i = waiting.popleft()
            if lacks[i]:
                for other in self._bid(i, int(lacks[i]), epsilon, lacks):
                    waiting.append(other)
                lacks[i] = 0
        at = np.flatnonzero((self.owner >= 0) & (self.units > 0))
        self.flows = sorted(zip(self.owner[at].tolist(), self.item[at].tolist(), self.units[at].tolist(), strict=True))
        self.total = float(sum(cost(i, np.array([j]))[0] * k for i, j, k in self.flows))
        there = self.units > 0
        level = [float((cost(i, self.item[there]) + self.price[there]).min()) * k for i, k in enumerate(need.tolist()) if k]
        self.bound = sum(level) - float((self.price[at] * self.units[at]).sum())

    def _bid(self, i: int, lacks: int, epsilon: float, missing: np.ndarray) -> list[int]:
        net = self.cost(i, self.item) + self.price
        net[(self.owner == i) | (self.units == 0)] = np.inf
        order = np.argsort(net, kind="stable")
        reached = np.cumsum(self.units[order])
        last = int(np.searchsorted(reached, lacks))
        rest = int(reached[last]) - lacks
        left = order[last] if rest else order[min(last + 1, len(order) - 1)]
        level = net[left] if np.isfinite(net[left]) else net[order[last]]
        worth = level + epsilon - self.cost(i, self.item)  # what the bidder would give for each lot
        mine = np.flatnonzero(self.owner == i)
        self.price[mine] = np.maximum(self.price[mine], worth[mine])
        losers = []
        for k, lot in enumerate(order[: last + 1].tolist()):
            units = int(self.units[lot]) - (rest if k == last else 0)
            owner, item = int(self.owner[lot]), int(self.item[lot])
            self.units[lot] -= units
            if owner >= 0:
                if not missing[owner]:
                    losers.append(owner)
                missing[owner] += units
            if not self.units[lot] and owner >= 0:
                del self._own[owner, item]
                self._empty.append(lot)
            self._give(i, item, units, float(worth[lot]))
        return losers

    def _give(self, i: int, item: int, units: int, price: float) -> None:
        lot = self._own.get((i, item))
        if lot is None:
            if not self._empty:
                size = len(self.item)
                self._empty = list(range(2 * size - 1, size - 1, -1))
                for name in ("item", "price", "units", "owner"):
                    setattr(self, name, np.concatenate([getattr(self, name), np.zeros(size, getattr(self, name).dtype)]))
            lot = self._own[i, item] = self._empty.pop()
            self.item[lot], self.owner[lot], self.units[lot], self.price[lot] = item, i, 0, price
        self.units[lot] += units
        self.price[lot] = max(self.price[lot], price)


def _solve(points: pd.DataFrame, penalty: float, epsilon: float) -> pd.DataFrame:
    """The flows of one block from its points (point, is_case, g, z, n); the rarer side bids."""
    a, b = points[points["is_case"]], points[~points["is_case"]]
    if not len(a) or not len(b):
        return pd.DataFrame(columns=["case", "control", "m", "case_from", "control_from", "cost", "bound"])
    few, many = (a, b) if a["n"].sum() <= b["n"].sum() else (b, a)
    kinds, _ = pd.factorize(pd.concat([few["g"], many["g"]]))
    (zi, gi), (zj, gj) = (few["z"].to_numpy(), kinds[: len(few)]), (many["z"].to_numpy(), kinds[len(few) :])

    def cost(i: int, items: np.ndarray) -> np.ndarray:
        return np.abs(zi[i] - zj[items]) + penalty * (gi[i] != gj[items])

    done = Auction(cost, few["n"].to_numpy(), many["n"].to_numpy(), epsilon)
    i, j, m = (np.array(x, np.int64) for x in zip(*done.flows, strict=True))
    f = pd.DataFrame({"few": few["point"].to_numpy()[i], "many": many["point"].to_numpy()[j], "m": m, "cost": np.abs(zi[i] - zj[j]) + penalty * (gi[i] != gj[j])})
    f["few_from"], f["many_from"] = (f.groupby(x)["m"].cumsum() - f["m"] for x in ("few", "many"))
    names = ("case", "control") if few is a else ("control", "case")
    f = f.rename(columns={"few": names[0], "many": names[1], "few_from": f"{names[0]}_from", "many_from": f"{names[1]}_from"})
    f["bound"] = 0.0
    f.loc[0, "bound"] = done.bound  # once a block
    return f[["case", "control", "m", "case_from", "control_from", "cost", "bound"]]


def nearest_controls(cases: DataFrame, controls: DataFrame, key: str, block: Sequence[str], size: str, group: str, penalty: float = 0.25, grid: float = GRID, epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """(pairs, flows).  pairs: case_id, control_id, cost; each row of a block's rarer side gets a partner of its own.

    Cost: distance of the z-scored log of ``size`` plus ``penalty`` where ``group``
    differs.  The costs of a block add up to at most ``grid`` + ``epsilon`` a pair more
    than the least possible; with ``grid`` 0 sizes are taken as they are, and a
    block's problem is as large as it has distinct sizes.  Within a point rows
    go by id.  flows: points of both sides, rows that go from one to the other,
    their cost on the grid, and, summed over a block, a proven lower bound of it.

    A block without cases or controls gives nothing, as does a null in a block
    column, ``size`` or ``group``; sizes under 1e-8 count as that.  Ids are unique
    on each side.
    """
    cols = [key, *block, size, group]
    rows = cases.select(*cols, F.lit(True).alias("is_case")).unionByName(controls.select(*cols, F.lit(False).alias("is_case"))).na.drop()
    rows = rows.withColumn("_l", F.log(F.greatest(F.col(size), F.lit(1e-8))))
    scale = rows.agg(F.avg("_l").alias("_m"), F.stddev_samp("_l").alias("_s"))
    z = F.round((F.col("_l") - F.col("_m")) / F.coalesce(F.nullif(F.col("_s"), F.lit(0.0)), F.lit(1.0)), 9)
    rows = rows.crossJoin(F.broadcast(scale)).withColumn("exact", z)  # one row
    rows = rows.withColumn("z", F.round(F.round(F.col("exact") / grid) * grid, 9) if grid else F.col("exact"))
    rows = rows.withColumn("block", F.concat_ws("|", *[F.sha2(F.col(c).cast("string"), 256) for c in block])).withColumn("g", F.col(group).cast("string"))
    rows = rows.select(F.col(key).alias("id"), "is_case", "block", "g", "z", "exact", F.sha2(F.concat_ws("|", F.col("is_case").cast("string"), "block", F.sha2("g", 256), F.col("z").cast("string")), 256).alias("point"))

    points = rows.groupBy("block", "point", "is_case", "g", "z").agg(F.count("*").alias("n"))
    solve = lambda p: _solve(p, penalty, epsilon)
    flows = ready(points.groupBy("block").applyInPandas(solve, FLOWS))
    placed = ranked(rows.select("id", "point", "g", "exact"), ["point"], "id", name="i")

    def side(name: str, short: str) -> DataFrame:
        f = flows.select(F.col(name).alias("point"), "case", "control", F.col(f"{name}_from").alias("from"), "m")
        j = placed.join(f, "point").where((F.col("i") > F.col("from")) & (F.col("i") <= F.col("from") + F.col("m")))
        return j.select("case", "control", (F.col("i") - F.col("from")).alias("nth"), F.col("id").alias(f"{name}_id"), F.col("g").alias(f"g{short}"), F.col("exact").alias(f"z{short}"))

    both = side("case", "a").join(side("control", "b"), ["case", "control", "nth"])
    cost = F.abs(F.col("za") - F.col("zb")) + F.when(F.col("ga") == F.col("gb"), 0.0).otherwise(penalty)
    return both.select("case_id", "control_id", F.round(cost, 9).alias("cost")), flows
