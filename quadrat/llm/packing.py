"""Best-fit packing by a configuration linear program.

Documents become pieces of at most CAPACITY tokens.  All that the packing needs
is the histogram of piece lengths: at most CAPACITY numbers, whatever the
corpus.  On it the configuration programme is solved (one variable for each way
to fill a sequence) by multiplicative weights: a price for each length that
falls as the length is served, fills by knapsack dynamic programming at these
prices, until the fractional solution is within GAP of the bound that the prices
prove.  It is then rounded; what the rounding leaves is packed best-fit
decreasing, on the histogram.

Where lengths abound, a fill can be exactly full, and then no packing does better.
So the weights are first followed over such fills alone, in whole numbers
(``perfect``): each round prices the lengths, the dynamic programme gives a full
sequence around every length, and each is used as often as its scarcest length
allows for the round.  A reserve, mostly of short pieces, is left out, so that
best-fit decreasing closes what stays.  What full sequences can't hold goes to
the programme with any fills.

The plan says how many sequences get which fill.  Spark numbers the pieces of
each length and each piece looks up its sequence and place.

Defined results
- null text: the empty text, a piece of one token (the closing id)
- a piece longer than the capacity can't occur; a longer document is cut
- equal pieces are interchangeable; repeated rows are packed one by one
- an empty table gives an empty result and no sequence
- very long texts are tokenised whole, word by word
- columns other than key and text are not carried
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quadrat.llm.common import stored
from quadrat.llm.words import LOWER, groups, word_places

CAPACITY = 2048
CLOSING_ID = 0
#: Words, and runs of letters, whose ids a Python worker remembers at most: about 150 MB.
REMEMBERED, RUNS = 1 << 21, 300_000
#: Pieces of one length that are numbered in one group.
GROUP = 1_000_000


#: Line ends and tabs are blanks to the tokenizer, and it lower-cases: doing both first makes more words alike.
SPLIT = bytes(32 if b in b"\t\n\r" else LOWER[b] for b in range(256))


class WordIds:
    """Ids of texts by a public tokenizer, remembered word by word.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are those of its words, one after the other.  Words are known by a
    64-bit hash in an open table of numpy arrays; only a word that isn't there
    yet is tokenised.  The table starts anew when it holds REMEMBERED words.
    """

    _simple = re.compile(r"([a-zß-öø-ÿ]+)([.,!?;:|*#$%&()-]*)")

    def __init__(self, name: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self._bpe = self.tokenizer.model.tokenize
        letters = "".join(map(chr, (*range(0xDF, 0xF7), *range(0xF8, 0x100))))
        # how the model sees a letter beyond ASCII; printable ASCII is as it is
        self._shown = str.maketrans({c: "".join(t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in letters})
        self._clear()

    def _clear(self) -> None:
        slots = 2 << (REMEMBERED - 1).bit_length()
        self._runs: dict[str, list[int]] = {}
        self._hash, self._word = np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        self._first, self._ids = np.zeros(1, np.int64), np.empty(0, "<u4")

    def _run(self, s: str) -> list[int]:
        """Ids of a run of letters or a run of marks."""
        if (ids := self._runs.get(s)) is None:
            if len(self._runs) >= RUNS:
                self._runs.clear()
            ids = self._runs[s] = [t.id for t in self._bpe(s if s.isascii() else s.translate(self._shown))]
        return ids

    def _tokenise(self, word: str) -> list[int]:
        if m := self._simple.fullmatch(word):
            return self._run(m[1]) + self._run(m[2]) if m[2] else self._run(m[1])
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 if it isn't known."""
        mask = len(self._hash) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        out = self._word[slot]
        go = np.flatnonzero((out >= 0) & (self._hash[slot] != hashes))
        while len(go):
            slot[go] = (slot[go] + 1) & mask
            out[go] = self._word[slot[go]]
            go = go[(out[go] >= 0) & (self._hash[slot[go]] != hashes[go])]
        return out

    def _learn(self, hashes: np.ndarray, found: list[list[int]]) -> None:
        """Words that aren't there yet, each once."""
        numbers = np.arange(len(self._first) - 1, len(self._first) - 1 + len(hashes), dtype=np.int32)
        self._first = np.concatenate([self._first, self._first[-1] + np.cumsum([len(x) for x in found])])
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(found), "<u4")])
        mask, go = len(self._hash) - 1, np.arange(len(hashes))
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        while len(go):
            free = go[self._word[slot[go]] < 0]
            self._word[slot[free]] = numbers[free]  # of several at one slot the last stays
            self._hash[slot[free]] = hashes[free]
            go = go[self._word[slot[go]] != numbers[go]]
            slot[go] = (slot[go] + 1) & mask

    def _of_words(self, joined: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of at most half as many words as are remembered, one after the other, and how many each word has."""
        word = self._find(hashes)
        new = np.flatnonzero(word < 0)
        if len(new) and len(self._first) + len(new) > REMEMBERED:
            self._clear()
            word[:], new = -1, np.arange(len(hashes))
        if len(new):
            fresh, at = np.unique(hashes[new], return_index=True)
            shown = [joined[a:z].decode() for a, z in zip(start[new[at]].tolist(), end[new[at]].tolist(), strict=True)]
            self._learn(fresh, [self._tokenise(w) for w in shown])
            word[new] = self._find(hashes[new])
        n = self._first[word + 1] - self._first[word]
        before = np.cumsum(n) - n
        return self._ids[np.repeat(self._first[word] - before, n) + np.arange(int(n.sum()))], n

    def of_many(self, texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the first id of each text and the end."""
        joined, start, end, hashes, first = word_places(texts, SPLIT)
        step = REMEMBERED // 2
        parts = [self._of_words(joined, start[i : i + step], end[i : i + step], hashes[i : i + step]) for i in range(0, len(hashes), step)]
        ids, n = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, "<u4"), np.empty(0, np.int64))
        return ids, np.concatenate([[0], np.cumsum(n)])[first]

    def of(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        return self.of_many([text.encode()])[0].tobytes()


_tokenizers: dict[str, WordIds] = {}


def word_ids(name: str) -> WordIds:
    """The tokenizer of that name; a Python worker keeps it from task to task."""
    return _tokenizers.get(name) or _tokenizers.setdefault(name, WordIds(name))


def _cut(name: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(name)
        end = np.array([CLOSING_ID], "<u4").tobytes()
        for b in batches:
            column = b.column("text").cast(pa.binary())
            for lo, hi in groups(pc.fill_null(pc.binary_length(column), 0).to_pylist()):  # a result for each group, so a worker stays small
                which, rows = [], []
                ids, cuts = ids_of.of_many([t or b"" for t in column.slice(lo, hi - lo).to_pylist()])
                whole = memoryview(ids.tobytes())
                for i, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), lo):
                    for p, at in enumerate(range(a, z + 1, capacity)):  # one place more: the closing id
                        part = whole[4 * at : 4 * min(at + capacity, z)]
                        if z < at + capacity:
                            part = bytes(part) + end
                        which.append(i)
                        rows.append((p, at - a, len(part) // 4, zlib.crc32(part), bytes(part) if keep_ids else None))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                out = [b.column("key").take(pa.array(which, pa.int64()))]
                out += [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays(out, ["key", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    return d.mapInArrow(_cut(tokenizer, capacity, keep_ids), f"key {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


# -- the programme over the histogram ------------------------------------------------------


#: Where the programme stops: fractional sequences over the lower bound.
GAP = 1.05
#: Near-best fills are taken up to this share below the best; a step serves a length by STEP of its pieces at most.
SLACK, STEP, SHARPNESS = 0.1, 0.02, 20.0
#: Steps of the weights between two knapsacks; after WAIT knapsacks without progress slack and step are halved, HALVINGS times at most.
STEPS, WAIT, HALVINGS = 20, 30, 4

#: Full sequences: share of each length that is left out, more of it of short pieces (about SHORT tokens), and how much may stay beyond that.
RESERVE, RESERVE_SHORT, SHORT, STAYS = 0.03, 0.8, 30, 0.04
#: Near-best choices, sharpness of the weights and share of a length for a round; a round that places less than STALL of the pieces widens the share.
CHOICE, PULL, SHARE, STALL = 0.05, 10.0, 0.04, 0.0005


@dataclass
class Plan:
    """fills: (lengths in one sequence, how many sequences are so).

    bound: no packing needs fewer; value: sequences of the fractional programme;
    programme: pieces that its fills hold, the rest is best-fit decreasing.
    """

    fills: list[tuple[tuple[int, ...], int]]
    bound: int
    value: float = 0.0
    programme: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.fills)


def knapsack(prices: np.ndarray, plenty: np.ndarray, noise: np.ndarray, rng: np.random.Generator, slack: float = SLACK) -> tuple[float, np.ndarray, np.ndarray]:
    """Dynamic programming over the room, any number of each length: value of the best fill, value of a near-best one for each room, and the length it takes first.

    prices, plenty: for each length from 0 to the capacity, minus infinity where
    there is none.  Of the choices that lose less than ``slack`` of a piece's price
    one is drawn, the more often the more pieces it has, so that the fills of
    one knapsack differ.
    """
    capacity = len(prices) - 1
    best, path, first = np.zeros(capacity + 1), np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)  # from full to no room
    cost, extra, plenty = prices[1:], slack * prices[1:], plenty[1:]
    shifts = rng.integers(0, len(noise) - capacity, capacity + 1)
    for room in range(1, capacity + 1):
        at = capacity - room
        best[at] = max(best[at + 1], (best[at + 1 :] + cost[:room]).max())
        got = path[at + 1 :] + cost[:room]
        most, less = got.max(), path[at + 1]
        path[at] = less
        if most > less:
            near = (got + extra[:room] >= most) & (got >= less)
            k = int(np.where(near, plenty[:room] + noise[shifts[room] : shifts[room] + room], -np.inf).argmax())
            path[at], first[at] = got[k], k + 1
    return float(best[0]), path[::-1], first[::-1]


def full_knapsack(prices: np.ndarray, plenty: np.ndarray, noise: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """As ``knapsack``, over fills that leave nothing of the room: value for each room, minus infinity where there is no such fill, and the length it takes first."""
    capacity = len(prices) - 1
    path, first = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)  # from full to no room
    path[capacity] = 0.0
    cost, extra, plenty = prices[1:], CHOICE * prices[1:], plenty[1:]
    shifts = rng.integers(0, len(noise) - capacity, capacity + 1)
    for room in range(1, capacity + 1):
        at = capacity - room
        got = path[at + 1 :] + cost[:room]
        if (most := got.max()) > -np.inf:
            k = int(np.where(got + extra[:room] >= most, plenty[:room] + noise[shifts[room] : shifts[room] + room], -np.inf).argmax())
            path[at], first[at] = got[k], k + 1
    return path[::-1], first[::-1]


def perfect(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], int], dict[int, int]]:
    """Full sequences by multiplicative weights, in whole numbers, and the pieces that stay.

    Ends when STAYS of the pieces are left beside the reserve, or when a round
    without a limit on shares places less than STALL of them, so after
    1 / STALL rounds and a few at most.
    """
    lengths = np.array(sorted(histogram), np.int64)
    whole = np.array([histogram[int(n)] for n in lengths], np.int64)
    rng = np.random.default_rng(0)  # one histogram, one plan
    noise = rng.gumbel(size=1 << 18)
    kept = np.floor((RESERVE + RESERVE_SHORT * np.exp(-lengths / SHORT)) * whole + rng.random(len(whole))).astype(np.int64)
    need = whole - np.minimum(kept, whole)
    left, share, total = need.copy(), SHARE, int(whole.sum())
    fills: dict[tuple[int, ...], int] = {}
    while left.sum() > STAYS * total:
        served = 1 - left / np.maximum(need, 1)
        on = left > 0
        weight = lengths * np.exp(-PULL * (served - served[on].min()))
        prices, plenty = np.full(capacity + 1, -np.inf), np.full(capacity + 1, -np.inf)
        prices[lengths[on]], plenty[lengths[on]] = weight[on] / weight[on].max(), np.log(left[on])
        path, first = full_knapsack(prices, plenty, noise, rng)
        own = np.flatnonzero(on & (path[capacity - lengths] > -np.inf))
        fill, piece = columns(first, lengths, own) if len(own) else (own, own)
        order = np.argsort(fill, kind="stable")
        piece, cuts = piece[order].tolist(), np.searchsorted(fill[order], np.arange(len(own) + 1)).tolist()
        limit = np.minimum(left, np.maximum(1, np.ceil(share * need))).astype(np.int64).tolist()
        placed = 0
        for i in rng.permutation(len(own)).tolist():
            held = Counter(piece[cuts[i] : cuts[i + 1]])
            n = min(limit[v] // k for v, k in held.items())
            if n:
                key = tuple(sorted((int(lengths[v]) for v in held.elements()), reverse=True))
                fills[key] = fills.get(key, 0) + n
                for v, k in held.items():
                    limit[v] -= n * k
                    left[v] -= n * k
                placed += n * held.total()
        if placed < STALL * total:
            if share >= 1:
                break
            share = min(1.0, 2 * share)
    stay = whole - need + left
    return fills, {int(n): int(c) for n, c in zip(lengths, stay, strict=True) if c}


def columns(first: np.ndarray, lengths: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fill, number of the length) for each piece in the fills that begin with the lengths ``own``."""
    capacity = len(first) - 1
    number = np.zeros(capacity + 1, np.int64)
    number[lengths] = np.arange(len(lengths))
    stop = np.maximum.accumulate(np.where(first > 0, np.arange(capacity + 1), 0))  # room that nothing uses is skipped
    fill, room = np.arange(len(own)), stop[capacity - lengths[own]]
    fills, pieces_ = [fill], [own]
    while (go := room > 0).any():
        fill, room = fill[go], room[go]
        fills.append(fill)
        pieces_.append(number[first[room]])
        room = stop[room - first[room]]
    return np.concatenate(fills), np.concatenate(pieces_)


def programme(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[tuple[int, ...], float], float, float]:
    """Fills with fractional amounts that serve every length, their sum, and a lower bound of any such sum.

    Covering by multiplicative weights.  A length's weight falls exponentially
    with the share of it that is served.  A knapsack at these weights bounds the
    programme from below and gives, for each length, a near-best fill that holds
    it; then, for STEPS steps, all known fills within SLACK of the best weight
    are used a little, none beyond STEP of a length.  The amounts since any
    earlier knapsack, divided by the least share served since, are a solution;
    the best one counts.  Without progress, slack and step are halved.
    """
    lengths = np.array(sorted(histogram), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], float)
    rng = np.random.default_rng(0)  # one histogram, one plan
    noise = rng.gumbel(size=1 << 18)
    start = lengths / (lengths @ need)
    plenty = np.full(capacity + 1, -np.inf)
    plenty[lengths] = np.log(need)
    served, total = np.zeros(len(lengths)), 0.0
    of, piece, base, amount = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
    earlier: list[tuple[np.ndarray, float, np.ndarray]] = []
    mean = None
    value, bound, answer, since = np.inf, float(lengths @ need) / capacity, amount, 0
    slack, step, halved = SLACK, STEP, 0
    while value > GAP * bound:
        if since >= WAIT:
            if halved == HALVINGS:
                break
            slack, step, halved, since = slack / 2, step / 2, halved + 1, 0
        weight = start * np.exp(-SHARPNESS * (served - served.min()))
        weight /= weight @ need
        prices = np.full(capacity + 1, -np.inf)
        prices[lengths] = weight
        top, path, first = knapsack(prices, plenty, noise, rng, slack)
        mean = weight if mean is None else 0.9 * mean + 0.1 * weight
        if len(earlier) % 5 == 4:  # weights swing about the best ones, so their mean proves more
            prices[lengths] = mean
            bound = max(bound, 1 / knapsack(prices, plenty, noise, rng)[0])
        bound = max(bound, 1 / top)
        own = np.flatnonzero(weight + path[capacity - lengths] >= (1 - slack) * top)
        f, p = columns(first, lengths, own)
        earlier.append((served.copy(), total, amount.copy()))
        of, piece = np.concatenate([of, f + len(amount)]), np.concatenate([piece, p])
        held = np.bincount(f[p == own[f]], minlength=len(own))
        base = np.concatenate([base, need[own] / held])
        amount = np.concatenate([amount, np.zeros(len(own))])
        for _ in range(STEPS):
            weight = start * np.exp(-SHARPNESS * (served - served.min()))
            worth = np.bincount(of, weight[piece], minlength=len(amount))
            on = worth >= (1 - slack) * worth.max()
            use = np.where(on, base, 0) * step
            o, q = of[on[of]], piece[on[of]]
            limit = np.minimum(1, step / np.maximum(np.bincount(q, use[o], minlength=len(need)) / need, 1e-300))
            least = np.ones(len(use))
            np.minimum.at(least, o, limit[q])
            use *= least
            amount += use
            total += use.sum()
            served += np.bincount(q, use[o], minlength=len(need)) / need
        since += 1
        for s, t, x in earlier:
            share = (served - s).min()
            if share > 0 and (total - t) / share < value:
                since = since if (total - t) / share > 0.999 * value else 0
                value = (total - t) / share
                answer = (amount - np.pad(x, (0, len(amount) - len(x)))) / share
    sums: dict[tuple[int, ...], float] = {}
    order = np.lexsort((-lengths[piece], of))
    used, cuts = lengths[piece][order].tolist(), np.searchsorted(of[order], np.arange(len(answer) + 1))
    for i in np.flatnonzero(answer > 0):
        fill = tuple(used[cuts[i] : cuts[i + 1]])
        sums[fill] = sums.get(fill, 0.0) + float(answer[i])
    return sums, float(value), bound


def rounded(sums: dict[tuple[int, ...], float], histogram: dict[int, int], capacity: int, waste: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Whole fills that leave at most ``waste`` free, and what stays: amounts rounded down, fullest fills first; then one more of each fill that still fits."""
    left, out = dict(histogram), {}
    fills = [(capacity - sum(f), -x, f, {v: f.count(v) for v in set(f)}) for f, x in sums.items() if capacity - sum(f) <= waste]
    for more in (False, True):
        for _, x, f, held in sorted(fills, key=lambda r: r[:3] if not more else (r[0], -(-r[1] % 1), r[2])):
            n = min(1 if more else int(-x + 1e-9), *(left[v] // k for v, k in held.items()))
            if n > 0:
                out[f] = out.get(f, 0) + n
                for v, k in held.items():
                    left[v] -= n * k
    return list(out.items()), {n: c for n, c in left.items() if c}


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Fills for all pieces.  Work depends on the number of lengths, not on the counts.

    Full sequences first; if more than a tenth of the pieces stay, the programme
    with any fills is solved for them, and for all pieces as another plan.  Its
    amounts are rounded with fills that leave nothing, a hundredth, and any room
    free, and it is solved again for what stays until that is less than a tenth;
    the last is packed best-fit decreasing.  The fewest sequences win,
    at a tie the plan with more pieces in fills of the programme.  Best-fit
    decreasing alone is one of the plans, so none is worse than it.
    """
    histogram = {n: c for n, c in histogram.items() if c > 0}
    if not histogram:
        return Plan([], 0)
    total, tokens = sum(histogram.values()), sum(n * c for n, c in histogram.items())
    least = -(-tokens // capacity)
    plans = [Plan(best_fit(histogram, capacity), least, tokens / capacity)]

    def add(fills: list[tuple[tuple[int, ...], int]], left: dict[int, int]) -> None:
        plans.append(Plan(best_fit(left, capacity, fills), least, tokens / capacity, total - sum(left.values())))

    def rounds(of: dict[int, int], fills: list[tuple[tuple[int, ...], int]]) -> tuple[float, float]:
        first = None
        while sum(of.values()) > 0.1 * total:
            sums, *proven = programme(of, capacity)
            first = first or proven
            for waste in (0, capacity // 100, capacity):
                more, left = rounded(sums, of, capacity, waste)
                add(fills + more, left)
            if not more:
                break
            fills, of = fills + more, left
        return first

    made, stay = perfect(histogram, capacity)
    full = list(made.items())
    add(full, stay)
    value = tokens / capacity
    if sum(stay.values()) > 0.1 * total:
        value, bound = rounds(histogram, [])
        least = max(least, -(-int(bound * (1 - 1e-9) * 1e6) // 10**6))
        rounds(stay, full)
    best = min(plans, key=lambda p: (p.sequences, -p.programme))
    return Plan(best.fills, least, value, best.programme)


def best_fit(left: dict[int, int], capacity: int, fills: Sequence[tuple[tuple[int, ...], int]] = ()) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts, into the room that ``fills`` leave and new sequences: those with equal contents are one group."""
    rooms: dict[int, list[list]] = {}  # room -> groups [contents, count]
    for fill, k in fills:
        rooms.setdefault(capacity - sum(fill), []).append([fill, k])
    open_rooms = list(rooms)
    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            fitting = [r for r in open_rooms if r >= n]
            if fitting:
                room = min(fitting)
                group = rooms[room][-1]
                k = min(count, group[1])
                contents = group[0]
                group[1] -= k
                if not group[1]:
                    rooms[room].pop()
                    if not rooms[room]:
                        del rooms[room]
                        open_rooms.remove(room)
            else:
                # as many new sequences as hold the rest, each as full of this length as it gets
                per = capacity // n
                k, contents, room = max(1, count // per), (n,) * (per - 1), capacity - (per - 1) * n
                if count < per:
                    k, contents, room = 1, (n,) * (count - 1), capacity - (count - 1) * n
                count -= k * len(contents)
            if room - n not in rooms:
                rooms[room - n] = []
                open_rooms.append(room - n)
            rooms[room - n].append([contents + (n,), k])
            count -= k
    return [(tuple(c), k) for groups in rooms.values() for c, k in groups]


# -- from the plan to the pieces -------------------------------------------------------------


def _slots(plan: Plan) -> pd.DataFrame:
    """For each length its runs of slots: from which number on, the first sequence, the offset there."""
    rows, first, taken = [], 0, {}
    for fill, n in plan.fills:
        offset = 0
        for v in fill:
            rows.append((v, taken.get(v, 0), first, offset))
            taken[v] = taken.get(v, 0) + n
            offset += v
        first += n
    return pd.DataFrame(rows, columns=["length", "number", "sequence", "offset"]).astype("int64").sort_values(["length", "number"], ignore_index=True)


def numbered(pieces: DataFrame, group: Column, *order: str) -> DataFrame:
    """``pieces`` with a number from 0 among those of the same length.

    Pieces of a length are numbered in parts of about ``group`` rows, so a task
    sorts that many whatever the corpus.  ``order`` names columns that decide in
    a part and deal the pieces to parts.
    """
    kinds = pieces.groupBy("length").agg(F.count("*").alias("n")).select("length", F.greatest(F.lit(1), F.ceil(F.col("n") / group)).alias("parts"))
    dealt = pieces.join(F.broadcast(kinds), "length")  # a row for each length below the capacity
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64(*order), F.col("parts")))
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("ahead"))  # a row for ``group`` pieces
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy(*order))
    joined = dealt.withColumn("rank", rank).join(ahead.hint("merge"), ["length", "part"])
    return joined.withColumn("number", F.col("ahead") + F.col("rank") - 1)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, Plan]:
    """The pieces with sequence_id and offset, and the plan.  ``cut`` is read more than once: store it first.

    A piece of the whole capacity is a sequence by itself and isn't numbered.
    The others are numbered in groups of one length and about GROUP pieces by
    hash, so a task sorts that many whatever the corpus.
    """
    spark = cut.sparkSession
    short = cut.where(F.col("length") < capacity)
    counts = short.groupBy("length").count().toPandas()  # at most ``capacity`` rows
    plan = solve({int(n): int(c) for n, c in zip(counts["length"], counts["count"], strict=True)}, capacity)
    slots = spark.sparkContext.broadcast(_slots(plan))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        s, wide = slots.value, 1 << 42
        at = np.searchsorted(s["length"].to_numpy() * wide + s["number"].to_numpy(), length.to_numpy(np.int64) * wide + number.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": s["sequence"].to_numpy()[at] + number - s["number"].to_numpy()[at], "offset": s["offset"].to_numpy()[at]})

    placed = numbered(short, F.lit(GROUP), "key", "piece", "ids_crc32").withColumn("_p", place("length", "number")).select(*cut.columns, "_p.sequence_id", "_p.offset")
    # rows of a stored table are numbered alike however often a task is run
    whole = cut.where(F.col("length") == capacity).select(*cut.columns, (F.monotonically_increasing_id() + plan.sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole), plan


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, keep_ids: bool = False) -> tuple[DataFrame, Plan]:
    """All documents packed: key, piece, start, length, ids_crc32, ids, sequence_id, offset.  The plan is that of the pieces shorter than the capacity."""
    return assign(stored(pieces(docs, key, text, tokenizer, capacity, keep_ids), "packing-pieces"), capacity)
