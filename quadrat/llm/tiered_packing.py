"""Hierarchical packing into several context sizes, without padding.

A document's ids, with a closing id, are cut into pieces of at most the longest
context; only documents beyond that are cut here.  All else is planned on the
histogram of piece lengths, at most one number for each length below the longest
context, whatever the corpus:

1. Routing: a piece belongs to the smallest tier (context size) that holds it.
2. Each tier, from the longest, packs its own pieces best-fit decreasing.
3. Gaps of its sequences are filled with whole pieces of shorter tiers, longest
   first, each into the smallest gap that holds it.
4. What is still open is closed by a cut: a shorter tier's longest piece gives
   as much as the gap takes, the rest of it stays in stock.  When the stock is
   empty, the emptiest sequences of the tier are taken apart and fill the others.
5. Less than one smallest context stays at the end, and is dealt to sequences of
   powers of two.

So every sequence is as long as a power of two and none is padded; at most one
cut closes a sequence.  Steps of equal tokens are formed of sequences of one tier
and laid out so that each stretch of steps holds every tier by its share.

Pieces of the plan are known by length and number.  A cut makes two kinds of
pieces of one, each with numbers of its own; ``Plan.table`` leads them back to the
pieces of the corpus.  Spark numbers the pieces of each length, and each piece
looks its parts up.

Defined results
- null text: the empty text, a piece of one token (the closing id)
- equal pieces are interchangeable; repeated rows are packed one by one
- an empty table gives an empty result and no sequence
- very long texts are tokenised whole; each full piece is a sequence by itself
- columns other than key and text are not carried
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import stored
from quadrat.llm.packing import numbered, word_ids
from quadrat.llm.words import groups

#: Context sizes: powers of two, rising.
TIERS = (256, 512, 1024, 2048)
CLOSING_ID = 1
#: Tokens of a step.
STEP = 1 << 16


# -- pieces ------------------------------------------------------------------------------------


def _tokens(name: str, capacity: int, closing: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, full = word_ids(name), TaskContext.get().partitionId(), 0
        narrow = "<u2" if max(closing, ids_of.tokenizer.get_vocab_size() - 1) < 1 << 16 else "<u4"
        for b in batches:
            column = b.column("text").cast(pa.binary())
            for lo, hi in groups(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                which, rows = [], []
                ids, cuts = ids_of.of_many([t or b"" for t in column.slice(lo, hi - lo).to_pylist()])
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), lo):
                    own = np.append(ids[a:z], np.uint32(closing)).astype("<u4", copy=False)
                    for at in range(0, len(own), capacity):
                        part = own[at : at + capacity]
                        whole = len(part) == capacity
                        kept = None if whole and not keep_ids else part.astype(narrow).tobytes()
                        which.append(i)
                        rows.append((at, len(part), zlib.crc32(part.tobytes()), len(own), task, full if whole else None, kept))
                        full += whole
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                out = [b.column("key").take(pa.array(which, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]]
                yield pa.RecordBatch.from_arrays(out, ["key", "start", "length", "ids_crc32", "doc_tokens", "task", "nth", "ids"])

    return run


def _wide(ids: bytes, length: int, start: int, end: int) -> bytes:
    """Ids from start to end as little-endian 32-bit numbers."""
    return np.frombuffer(ids, f"<u{len(ids) // length}")[start:end].astype("<u4").tobytes()


def pieces(docs: DataFrame, key: str, text: str, tokenizer: str, capacity: int, closing: int, keep_ids: bool) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens; task, nth: number of a full piece in its task; ids, of 16 bits each if they fit: null for full pieces unless asked for."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(_tokens(tokenizer, capacity, closing, keep_ids), f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long, ids binary")


# -- the plan over the histogram -----------------------------------------------------------------


class Plan:
    """Sequences of each tier as groups (kinds of pieces in one sequence, how many sequences are so).

    A kind is a length of the histogram or a part that a cut has made of a
    kind.  Work depends on the number of lengths, not on the counts.
    """

    def __init__(self, histogram: dict[int, int], tiers: Sequence[int] = TIERS):
        self.tiers = tuple(tiers)
        self.fills: list[tuple[int, tuple[int, ...], int]] = []  # tokens of a sequence, kinds, sequences
        self.cuts = 0  # of pieces, beyond those at the longest context
        self._length: list[int] = []
        self._parent: list[tuple[int, int, int]] = []  # kind it was cut from (-1: none), first number there, place in the piece
        self._taken: list[int] = []  # numbers that are given away
        self._stock: dict[int, list[list[int]]] = {}  # length -> [kind, pieces]
        self._lengths: list[int] = []  # of the stock, rising
        for n, count in sorted(histogram.items()):
            if count > 0:
                self._put(self._kind(n, -1, 0, 0), count)
        for i in reversed(range(len(self.tiers))):
            self._tier(self.tiers[i], self.tiers[i - 1] if i else 0)
        rest = sum(n * c for n, held in self._stock.items() for _, c in held)
        for bit in reversed(range(rest.bit_length())):  # less than the smallest tier
            if rest >> bit & 1:
                self._close([[(), 1, 1 << bit]], 1 << bit)

    def _kind(self, length: int, parent: int, first: int, place: int) -> int:
        self._length.append(length)
        self._parent.append((parent, first, place))
        self._taken.append(0)
        return len(self._length) - 1

    def _put(self, kind: int, count: int) -> None:
        n = self._length[kind]
        if n not in self._stock:
            self._stock[n] = []
            insort(self._lengths, n)
        self._stock[n].append([kind, count])

    def _take(self, n: int, count: int) -> tuple[int, int]:
        """Kind and number, ``count`` at most, of pieces of length n out of the stock."""
        kind, there = self._stock[n][-1]
        count = min(count, there)
        self._stock[n][-1][1] -= count
        if count == there:
            self._stock[n].pop()
            if not self._stock[n]:
                del self._stock[n]
                self._lengths.remove(n)
        return kind, count

    def _cut(self, kind: int, count: int, at: int) -> int:
        """Pieces of a kind cut at ``at``: the kind of their heads; the tails go to the stock."""
        first = self._taken[kind]
        self._taken[kind] += count
        self.cuts += count
        place = self._parent[kind][2]
        head = self._kind(at, kind, first, place)
        self._put(self._kind(self._length[kind] - at, kind, first, place + at), count)
        return head

    def _tier(self, size: int, below: int) -> None:
        while self._lengths and self._lengths[-1] > size:  # left by a longer tier
            kind, count = self._take(self._lengths[-1], 1 << 62)
            self.fills.append((size, (self._cut(kind, count, size),), count))
        rooms: dict[int, list[list]] = {}  # room -> [kinds, sequences]
        open_: list[int] = []

        def leave(room: int, kinds: tuple[int, ...], count: int) -> None:
            if room not in rooms:
                rooms[room] = []
                insort(open_, room)
            rooms[room].append([kinds, count])

        for n in self._lengths[::-1]:
            while n in self._stock:
                at = bisect_left(open_, max(n, 1))
                if at == len(open_):
                    if n <= below:
                        break  # waits for its own tier, or for a cut
                    kind, count = self._take(n, 1 << 62)
                    per = size // n
                    if count // per:
                        leave(size - per * n, (kind,) * per, count // per)
                    if count % per:
                        leave(size - count % per * n, (kind,) * (count % per), 1)
                    continue
                room = open_[at]
                kinds, there = rooms[room][-1]
                kind, count = self._take(n, there)
                rooms[room][-1][1] -= count
                if count == there:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        open_.pop(at)
                leave(room - n, (*kinds, kind), count)
        self.fills += [(size, tuple(kinds), count) for kinds, count in rooms.pop(0, [])]
        self._close([[kinds, count, room] for room in sorted(rooms, reverse=True) for kinds, count in rooms[room]], size)

    def _close(self, groups_: list[list], size: int) -> None:
        """Fill all room of the groups [kinds, sequences, room], the fullest, at the end, first."""
        while groups_:
            if not self._lengths:
                # as many of the emptiest are taken apart as fill all others
                kinds, count, room = groups_[0]
                apart = min(count, -(-sum(c * r for _, c, r in groups_) // size))
                groups_[0][1] -= apart
                if apart == count:
                    groups_.pop(0)
                for kind in kinds:
                    self._put(kind, apart)
                continue
            kinds, count, room = groups_[-1]
            n = room if room in self._stock else self._lengths[-1]
            kind, some = self._take(n, count)
            if n > room:
                kind = self._cut(kind, some, room)
            groups_[-1][1] -= some
            if some == count:
                groups_.pop()
            if n >= room:
                self.fills.append((size, (*kinds, kind), some))
            else:
                groups_.append([(*kinds, kind), some, room - n])

    def sequences(self) -> dict[int, int]:
        """Tokens of a sequence -> sequences."""
        out: dict[int, int] = {}
        for size, _, count in self.fills:
            out[size] = out.get(size, 0) + count
        return out

    def table(self) -> pd.DataFrame:
        """For pieces of a length from number ``number`` on: a row for each of their parts: start, part, size of its sequence, number among those of that size, offset."""
        taken, made, rows = list(self._taken), {}, []
        for size, kinds, count in self.fills:
            offset, first = 0, made.get(size, 0)
            for kind in kinds:
                number, root = taken[kind], kind
                taken[kind] += count
                while self._parent[root][0] >= 0:
                    root, number = self._parent[root][0], number + self._parent[root][1]
                rows.append((self._length[root], number, number + count, self._parent[kind][2], self._length[kind], size, first, offset))
                offset += self._length[kind]
            made[size] = first + count
        t = pd.DataFrame(rows, columns=["length", "number", "end", "start", "part", "size", "sequence", "offset"]).astype("int64")
        # the parts of a piece may be used in other stretches of numbers than its other parts: cut all at all ends
        out = []
        for _, g in t.groupby("length"):
            edges = np.unique(np.concatenate([g["number"], g["end"]]))
            a, z = np.searchsorted(edges, g["number"]), np.searchsorted(edges, g["end"])
            row = np.repeat(np.arange(len(g)), z - a)
            at = edges[np.arange(len(row)) - np.repeat(np.cumsum(z - a) - (z - a), z - a) + np.repeat(a, z - a)]
            x = g.iloc[row].copy()
            x["sequence"] += at - x["number"].to_numpy()
            x["number"] = at
            out.append(x)
        every = pd.concat(out) if out else t
        return every.drop(columns="end").sort_values(["length", "number", "start"], ignore_index=True)


# -- steps ---------------------------------------------------------------------------------------


def step(size: Column, number: Column, sequences: dict[int, int], tokens: int = STEP) -> Column:
    """The step of a sequence by its size and its number among those of that size.

    Sequences of a size form groups of ``tokens`` (of one sequence, if that is longer).  The g-th of G groups stands at
    (2 g + 1) / G of the way, ties by size; a step is the place in that order.
    """
    per = {s: max(1, tokens // s) for s in sequences}
    all_ = {s: -(-n // per[s]) for s, n in sequences.items()}
    div = lambda a, b: F.call_function("div", a, F.lit(b).cast("long"))
    out = F.lit(None).cast("long")
    for s in all_:
        g = div(number, per[s])
        place = g
        for other in all_:
            if other != s:
                # groups h of the other size that stand before: (2 h + 1) / all < (2 g + 1) / own, a smaller size also at a tie
                over = (2 * g + 1) * all_[other] - all_[s] - (0 if other < s else 1)
                place = place + F.when(over < 0, F.lit(0).cast("long")).otherwise(F.least(div(over, 2 * all_[s]) + 1, F.lit(all_[other]).cast("long")))
        out = F.when(size == s, place).otherwise(out)
    return out


# -- from the plan to the pieces -----------------------------------------------------------------


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", tiers: Sequence[int] = TIERS, closing: int = CLOSING_ID, tokens: int = STEP, keep_ids: bool = False) -> tuple[DataFrame, Plan]:
    """All documents packed: key, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset, tier, step.  The plan is that of the pieces below the longest tier."""
    spark, longest = docs.sparkSession, tiers[-1]
    cut = stored(pieces(docs, key, text, tokenizer, longest, closing, keep_ids), "tiered-packing-pieces")
    short, full = cut.where(F.col("nth").isNull()), cut.where(F.col("nth").isNotNull())
    counts = short.groupBy("length").count().toPandas()  # fewer rows than the longest tier has tokens
    plan = Plan({int(n): int(c) for n, c in zip(counts["length"], counts["count"], strict=True)}, tiers)

    each = full.groupBy("task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ahead = each.select("task", "n", F.coalesce(before, F.lit(0)).alias("ahead"))  # a row a task
    n_full = each.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sequences = plan.sequences()
    sequences[longest] = sequences.get(longest, 0) + n_full
    first, base = 0, {}
    for size in sorted(sequences, reverse=True):
        base[size], first = first, first + sequences[size]

    table = plan.table()
    sent = spark.sparkContext.broadcast({c: table[c].to_numpy() for c in table})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, wide = sent.value, 1 << 48
        spots = t["length"] * wide + t["number"]
        for b in batches:
            spot = b.column("length").to_numpy() * wide + b.column("number").to_numpy()
            own = spots[np.searchsorted(spots, spot, side="right") - 1]
            lo, hi = np.searchsorted(spots, own), np.searchsorted(spots, own, side="right")
            parts = hi - lo
            row = np.repeat(np.arange(len(spot)), parts)
            at = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts) + np.repeat(lo, parts)
            beyond = (spot - own)[row]
            ids, length, crc = b.column("ids"), b.column("length").to_numpy(), b.column("ids_crc32").to_numpy()[row].copy()
            kept: list[bytes | None] = [None] * len(row)
            for k in np.flatnonzero((parts[row] > 1) | keep_ids).tolist():
                start = int(t["start"][at[k]])
                part = _wide(ids[int(row[k])].as_py(), int(length[row[k]]), start, start + int(t["part"][at[k]]))
                crc[k], kept[k] = zlib.crc32(part), part if keep_ids else None
            take = pa.array(row)
            columns = [b.column("key").take(take), pa.array(b.column("start").to_numpy()[row] + t["start"][at]), pa.array(t["part"][at]), pa.array(crc), b.column("doc_tokens").take(take), pa.array(kept, pa.binary())]
            columns += [pa.array(t["sequence"][at] + beyond), pa.array(t["offset"][at]), pa.array(t["size"][at])]
            yield pa.RecordBatch.from_arrays(columns, ["key", "start", "length", "ids_crc32", "doc_tokens", "ids", "number", "offset", "tier"])

    kind = cut.schema["key"].dataType.simpleString()
    # of one length about 64 MB of ids are numbered in one group
    placed = numbered(short, F.ceil(F.lit(1 << 25) / F.col("length")), "key", "start", "ids_crc32").select("key", "start", "length", "ids_crc32", "doc_tokens", "ids", "number").mapInArrow(place, f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, number long, offset long, tier long")
    number = F.col("ahead") + F.col("nth") + (sequences[longest] - n_full)

    @F.pandas_udf("binary")
    def wide(ids: pd.Series) -> pd.Series:
        return ids.map(lambda x: _wide(x, longest, 0, longest))

    if keep_ids:
        full = full.withColumn("ids", wide("ids"))
    whole = full.join(F.broadcast(ahead), "task").select("key", "start", "length", "ids_crc32", "doc_tokens", "ids", number.alias("number"), F.lit(0).cast("long").alias("offset"), F.lit(longest).cast("long").alias("tier"))
    every = placed.unionByName(whole)
    start = F.lit(0).cast("long")
    for size, n in base.items():
        start = F.when(F.col("tier") == size, F.lit(n).cast("long")).otherwise(start)
    out = every.select("key", "start", "length", "ids_crc32", "doc_tokens", "ids", (start + F.col("number")).alias("sequence_id"), "offset", "tier", step(F.col("tier"), F.col("number"), sequences, tokens).alias("step"))
    return out, plan
