"""Language identification as multilingual mixture inference.

A language is a smoothed distribution over hashed character n-grams (one to
three characters of the lower-cased text, letters only, words padded).  A
document is a mixture: expectation-maximisation estimates each language's
proportion from the n-gram likelihoods, and a language stays in the set only if
it raises the log-likelihood by more than its penalty, half the logarithm of the
number of n-grams for each free proportion.

The distributions are learnt from a bounded sample of labelled rows: about
SAMPLE_ROWS rows for each language, chosen by a hash of the key, so the bound
holds for any input; each row is read whole.  Prediction covers every row.

Defined results
- null text, or a text without a letter: language ``und``, no proportions, score 0
- no labelled row at all: ``und`` for every text
- a tie of proportions: the language that sorts first
- very long texts are counted in pieces, whole; repeated rows get a row each
- an empty table gives an empty result; other columns are not carried
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the fit reads for each language, about; the rest of the corpus isn't needed for it.
SAMPLE_ROWS = 3000
BUCKETS = 1 << 15
SMOOTHING = 0.5
STEPS, TOLERANCE = 30, 1e-4
#: Characters that are hashed at once.
PIECE = 1 << 20
UND = "und"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams and how often each occurs."""
    letter, total = _letter_table(), np.zeros(BUCKETS, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(points), PIECE):
        p = np.concatenate([[32, 32], points[max(0, at - 2) : at + PIECE], [32, 32]]).astype(np.uint64)
        on = letter[p]
        p[~on] = 32
        mult = np.uint64(0x9E3779B97F4A7C15)
        two = p[1:] * mult + p[:-1]
        three = p[2:] * mult + two[:-1] * np.uint64(0x2545F4914F6CDD1D)
        for h, keep in ((p * mult, on), (two, on[1:] | on[:-1]), (three, on[1:-1] | (on[2:] & on[:-2]))):
            h = h[keep]
            total += np.bincount(((h ^ (h >> np.uint64(29))) * mult >> np.uint64(64 - 15)).astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Profiles:
    """Names of the languages, sorted, and the likelihood of each bucket under each."""

    names: list[str]
    share: np.ndarray  # BUCKETS x languages

    def mixture(self, at: np.ndarray, n: np.ndarray) -> dict[str, float]:
        """Proportions of the languages that the penalty leaves."""
        p, total = self.share[at], n.sum()
        logs = n @ np.log(p)
        best = int(np.argmax(logs))
        chosen, now, weights = [best], logs[best], np.ones(1)
        cost = 0.5 * np.log(max(total, 2))
        while len(chosen) < len(self.names):
            mixed = p[:, chosen] @ weights
            # a language can help only if it makes the mean ratio exceed one
            gain = (n @ (p / mixed[:, None])) / total - 1
            gain[chosen] = -1
            k = int(np.argmax(gain))
            if gain[k] <= TOLERANCE or total * np.log1p(gain[k]) <= cost:
                break
            w, value = self._fit(p[:, [*chosen, k]], n, total)
            if value - now <= cost:
                break
            chosen, weights, now = [*chosen, k], w, value
        return {self.names[k]: float(w) for k, w in zip(chosen, weights, strict=True)}

    @staticmethod
    def _fit(p: np.ndarray, n: np.ndarray, total: int) -> tuple[np.ndarray, float]:
        """Proportions by expectation-maximisation, and the log-likelihood."""
        w = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(STEPS):
            mixed = p @ w
            new = w * ((n / mixed) @ p) / total
            done = np.abs(new - w).max() < TOLERANCE
            w = new
            if done:
                break
        return w, float(n @ np.log(p @ w))


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS) -> Profiles:
    """Profiles of all languages that label a row; about ``rows`` rows of each are read."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")
    sizes = d.groupBy("lang").count()
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / (1 << 20)
    chosen = d.join(F.broadcast(sizes), "lang").where(spread * F.col("count") < rows).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b["lang"], b["text"], strict=True):
                at, n = grams(t)
                sums.setdefault(name, np.zeros(BUCKETS, np.int64))[at] += n
        for name, s in sums.items():
            at = np.flatnonzero(s)
            yield pd.DataFrame({"lang": name, "bucket": at, "n": s[at]})

    total = chosen.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(total["lang"].unique())
    share = np.full((BUCKETS, len(names)), SMOOTHING)
    for k, name in enumerate(names):
        own = total[total["lang"] == name]
        share[own["bucket"].to_numpy(np.int64), k] += own["n"].to_numpy()
    return Profiles(names, share / share.sum(axis=0, keepdims=True) if names else share)


def predict(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (its proportion), mixture (language to proportion)."""
    d = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = d.schema["key"].dataType.simpleString()
    sent = d.sparkSession.sparkContext.broadcast(profiles)  # BUCKETS x languages, whatever the corpus

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for b in batches:
            out = []
            for t in b["text"]:
                at, n = grams(t) if t else (np.empty(0, int), np.empty(0, int))
                out.append(model.mixture(at, n) if len(at) and model.names else {})
            best = [min(m, key=lambda k: (-m[k], k)) if m else UND for m in out]
            yield pd.DataFrame({"key": b["key"], "lang_pred": best, "score": [min(1.0, m.get(k, 0.0)) for m, k in zip(out, best, strict=True)], "mixture": out})

    return d.mapInPandas(judge, f"key {kind}, lang_pred string, score double, mixture map<string,double>")
