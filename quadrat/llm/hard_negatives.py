"""Hard negatives by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  Each positive of
score p wants the best rows of other labels with a score in a window: at most
``upper`` and at least ``lower`` parts of p.  The windows of one anchor overlap,
but their upper limits, in falling order, split the scores into disjoint slots:
slot j holds what limit j lets through and limit j+1 doesn't.  A row falls into
one slot, whatever the number of windows, and of a slot no more than the best k
can matter to any window.  So

1. every task keeps, while it reads its rows, the best k of each slot of each
   anchor (the combiner); nothing else is shuffled,
2. the parts of a slot are merged to its best k,
3. the slots of an anchor, joined from the highest down, are one falling list;
   window j is the first k of its suffix that begins with slot j, less what lies
   below the window's lower limit.

The anchors are a stated query set; they go to the tasks in blocks of ``block``
(a few megabytes), and each block reads the rows twice, for its positives and
for its negatives.  The work is anchors x rows, as an exact search is; no pair
leaves a task but the best k.

Scores are integer inner products: components become floor(scale * x).  They
are multiplied as doubles where that is exact (all sums under 2**53), else as
64-bit or Python integers.

Defined results
- rows with a null id, label or vector, or a null or non-finite component take no part
- vectors of unequal length: components that one lacks count as 0
- ties in score: smaller id first; rows alike in id and score count once
- a row with an anchor's own id is none of its positives
- an anchor without positives, or a window without rows, gives nothing; so does an empty table
- a score beyond 64 bits is an error
- other columns, whatever their names, are not read
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored

#: Anchors that are sent to the tasks at once; scores that a task holds at once.
BLOCK, SCORES = 4096, 1 << 20
#: Candidates that a task gathers before it drops those that are no longer among the best.
GATHERED = 1 << 19
LEAST = np.iinfo(np.int64).min
FOUND = "anchor long, slot int, score long, id long"


def usable(table: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """id, label, vector (array of double) of the rows that take part."""
    v = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(F.col(f"`{key}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)


def whole_numbers(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of the lists, a row each, short ones filled with 0; as doubles, which hold the floors exactly."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    n = np.diff(offsets)
    out = np.zeros((len(n), int(n.max(initial=0))))
    out[np.arange(out.shape[1]) < n[:, None]] = np.floor(scale * flat[offsets[0] : offsets[-1]])
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``, as 64-bit integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, width)
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    if exact.size and (exact.max() > np.iinfo(np.int64).max or exact.min() < LEAST):
        raise OverflowError("a score doesn't fit 64 bits")
    return exact.astype(np.int64)


class Best:
    """The best k (score, then smaller id) of each slot of each anchor among what it is shown."""

    def __init__(self, anchors: int, slots: int, k: int):
        self.k, self.slots = k, slots
        # the last of the best so far: what a newcomer must reach, and under which id if it's a tie
        self.least, self.last = np.full((anchors, slots), LEAST), np.full((anchors, slots), np.iinfo(np.int64).max)
        self._rows: list[tuple[np.ndarray, ...]] = []
        self._n = 0

    def show(self, anchor: np.ndarray, slot: int, score: np.ndarray, ids: np.ndarray) -> None:
        better = (score > self.least[anchor, slot]) | (ids < self.last[anchor, slot])
        anchor, score, ids = anchor[better], score[better], ids[better]
        if len(anchor):
            self._rows.append((anchor, np.full(len(anchor), slot), score, ids))
            self._n += len(anchor)
            if self._n > GATHERED:
                kept = self.result()
                self._rows, self._n = [kept], len(kept[0])

    def result(self) -> tuple[np.ndarray, ...]:
        """anchor, slot, score, id."""
        a, j, s, i = (np.concatenate(x) for x in zip(*self._rows, strict=True)) if self._rows else (np.empty(0, np.int64),) * 4
        order = np.lexsort((i, -s, j, a))
        a, j, s, i = a[order], j[order], s[order], i[order]
        group = a * self.slots + j
        new = np.ones(len(a), bool)
        new[1:] = (group[1:] != group[:-1]) | (s[1:] != s[:-1]) | (i[1:] != i[:-1])  # equal rows count once
        a, j, s, i, group = a[new], j[new], s[new], i[new], group[new]
        rank = np.arange(len(a)) - np.searchsorted(group, group)
        last = rank == self.k - 1
        self.least[a[last], j[last]], self.last[a[last], j[last]] = s[last], i[last]
        keep = rank < self.k
        return a[keep], j[keep], s[keep], i[keep]


def search(rows: DataFrame, anchors: pd.DataFrame, limits: np.ndarray | None, k: int, scale: float) -> DataFrame:
    """anchor (its place in ``anchors``), slot, score, id: of each task the best k.

    Without ``limits``: rows of the anchor's label, one slot.  With them: rows of
    other labels; slot j of an anchor holds scores from limits[., j+1] + 1 to
    limits[., j]; its last column is what no window reaches below.
    """
    spark = rows.sparkSession
    own = whole_numbers(pa.array(anchors["vector"].tolist(), pa.list_(pa.float64())), scale)
    sent = spark.sparkContext.broadcast((anchors["id"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), own, limits))
    same = limits is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, vectors, limits = sent.value
        best = Best(len(ids), 1 if same else limits.shape[1] - 1, k)
        step = max(1, SCORES // max(1, len(ids)))
        for b in batches:
            there, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label"))
            theirs = whole_numbers(b.column("vector"), scale)
            for at in range(0, len(there), step):
                x, kind, score = there[at : at + step], kinds[at : at + step], products(vectors, theirs[at : at + step])
                alike = labels[:, None] == kind[None, :]
                if same:
                    r, c = np.nonzero(alike & (score >= best.least) & (ids[:, None] != x[None, :]))
                    best.show(r, 0, score[r, c], x[c])
                    continue
                for j in range(best.slots):
                    low = np.maximum(limits[:, j + 1] + 1, best.least[:, j])
                    r, c = np.nonzero((score >= low[:, None]) & (score <= limits[:, j, None]) & ~alike)
                    best.show(r, j, score[r, c], x[c])
        a, j, s, i = best.result()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(j, pa.int32()), pa.array(s, pa.int64()), pa.array(i, pa.int64())], ["anchor", "slot", "score", "id"])

    return rows.mapInArrow(run, FOUND)


def merged(found: DataFrame, k: int) -> DataFrame:
    """anchor, slot, score, id, rank: the best k of each slot over all tasks."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).dropDuplicates(["anchor", "slot", "rank"])


def mine(table: DataFrame, anchor: Column, key: str = "vec_id", label: Column | str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, lower: int = 30, upper: int = 90, scale: float = 256.0, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: condition on the columns id and label that makes a row an anchor;
    ``lower`` and ``upper``: the window in hundredths of the positive's score.
    """
    spark = table.sparkSession
    rows = usable(table, key, F.col(f"`{label}`") if isinstance(label, str) else label, vector)
    asked = stored(rows.where(anchor).distinct(), "hard-negative-anchors")
    n = max(1, -(-asked.count() // block))
    parts = []
    for i in range(n):
        own = asked.where(F.pmod(F.xxhash64("id"), F.lit(n)) == i).toPandas()  # about ``block`` rows
        if not len(own):
            continue
        near = merged(search(rows, own, None, positives, scale), positives).toPandas()  # ``positives`` rows an anchor
        if not len(near):
            continue
        scores = near["score"].tolist()  # Python's integers: no overflow, and // rounds down
        near["low"], near["high"] = [-(-lower * p // 100) for p in scores], [upper * p // 100 for p in scores]
        near = near.sort_values(["anchor", "rank"])
        who, at = np.unique(near["anchor"].to_numpy(), return_inverse=True)
        # an anchor with fewer positives has empty slots: limits no score is between
        limits = np.full((len(who), positives + 1), LEAST)
        limits[at, near["rank"].to_numpy() - 1] = near["high"].to_numpy()
        lowest = near.groupby("anchor")["low"].min().to_numpy() - 1
        limits[:, -1] = lowest
        limits = np.maximum(limits, lowest[:, None])
        told = pd.DataFrame({"anchor": at, "anchor_id": own["id"].to_numpy()[near["anchor"].to_numpy()], "positive_id": near["id"].to_numpy(), "positive_score": near["score"].to_numpy(), "slot": near["rank"].to_numpy() - 1, "low": near["low"].to_numpy()})
        found = merged(search(rows, own.iloc[who].reset_index(drop=True), limits, negatives, scale), negatives)
        # slots x negatives entries: one falling list an anchor, as slot 0 holds the highest scores
        lists = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", (-F.col("score")).alias("fall"), "id"))).alias("list"))
        windows = spark.createDataFrame(told, "anchor long, anchor_id long, positive_id long, positive_score long, slot int, low long").join(lists, "anchor")
        suffix = F.slice(F.filter("list", lambda e: e["slot"] >= F.col("slot")), 1, negatives)
        picked = windows.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda e: -e["fall"] >= F.col("low"))).alias("rank", "e"))
        out = picked.select("anchor_id", "positive_id", (F.col("rank") + 1).alias("rank"), F.col("e.id").alias("negative_id"), "positive_score", (-F.col("e.fall")).alias("negative_score"))
        parts.append(stored(out, "hard-negatives"))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    paths = [p for part in parts for p in part.inputFiles()]
    return spark.read.schema(parts[0].schema).parquet(*paths) if len(parts) > 1 else parts[0]
