"""Quality rules by a bitmask ledger.

Every text is measured once.  The ledger keeps the measurements and one bit for
each rule that fails; a policy is a mask of those bits with a version, so a new
policy or an ablation reads the ledger and never the texts.

Repeated windows are found inside the row: each window of five words has a
64-bit hash.  Only if the distinct hashes are fewer, the (hash, position) pairs
are sorted, and neighbours with equal hashes mark their words.

Defined results
- null text: no words, every measurement 0; it fails the rule ``too_few_words``
- a text of blanks only: the same
- fewer than five words: no window, so no repeated words
- lines: parts between ``\\n``; lines without a word are never duplicates
- repeated rows get a row each; an empty table gives an empty ledger
- columns of the input other than the key and the text are not carried
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import BLANKS

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name -> failing condition over the measurements; the place in this list is the bit.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbol_share", "n_words > 0 and 2 * n_symbols > n_words"),
    ("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 25 * n_words)"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named set of rules; a document is kept if none of them fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard-1", tuple(BIT))


def measurements(text: Column) -> dict[str, Column]:
    """Everything but the repeated windows, as columns over one text."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    inside = F.btrim(t, F.lit(BLANKS))  # so no part of the split is empty
    words = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"[\x20\x09-\x0D]+"))
    return {"lines": lines, "words": words, "n_symbols": F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))}


def window_hashes(hashes: Column) -> Column:
    """A hash for each window of five words, given a hash for each word."""
    n = F.size(hashes)
    return F.when(n > WINDOW, F.transform(F.slice(hashes, 1, n - (WINDOW - 1)), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, measurements and ``failed`` (long, one bit for each rule of RULES).

    One pass over the texts, without a shuffle.
    """
    m = measurements(F.col(f"`{text}`"))
    d = docs.select(F.col(f"`{key}`").alias(key), m["n_symbols"].cast("long").alias("n_symbols"), m["lines"].alias("_lines"), m["words"].alias("_words"))
    d = d.select(
        key,
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    d = d.withColumn("_windows", window_hashes(F.col("_hashes")))
    pairs = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    # start positions of windows that equal a neighbour in hash order
    same = lambda i, by: F.coalesce(F.get(F.col("_sorted"), i + by)["h"] == F.get(F.col("_sorted"), i)["h"], F.lit(False))
    marked = F.transform(F.filter(F.transform("_sorted", lambda s, i: F.struct(s["i"].alias("i"), ((i > 0) & same(i, -1) | same(i, 1)).alias("on"))), lambda s: s["on"]), lambda s: s["i"])
    d = d.withColumn("_starts", F.sort_array(marked))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    d = d.withColumn("n_repeat_words", covered)
    bits = F.lit(0).cast("long")
    for name, fails in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return d.select(key, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", bits.alias("failed"))


def judge(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The ledger with ``kept`` and ``policy``."""
    return book.withColumn("kept", F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0).withColumn("policy", F.lit(policy.version))


def keep(docs: DataFrame, policy: Policy = STANDARD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with all their columns; no shuffle.

    The verdict is a column before it selects, so the measurements are taken once.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    judged = judge(ledger(whole, key="row"), policy)
    return judged.select(F.explode(F.when(F.col("kept"), F.array("row")).otherwise(F.slice(F.array("row"), 1, 0))).alias("row")).select("row.*")


def ablation(book: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """rule, n_docs, n_failing, n_only (documents that only this rule of the policy rejects).

    ``n_only`` is what dropping the rule would bring back.  One aggregate over
    the bits; no text is read.
    """
    at = F.col("failed").bitwiseAND(F.lit(policy.mask))
    sums = [F.struct(F.lit(r).alias("rule"), F.count("*").alias("n_docs"), F.coalesce(F.sum((at.bitwiseAND(F.lit(BIT[r])) != 0).cast("long")), F.lit(0)).alias("n_failing"), F.coalesce(F.sum((at == BIT[r]).cast("long")), F.lit(0)).alias("n_only")) for r in policy.rules]
    return book.agg(F.array(*sums).alias("rows")).select(F.inline("rows"))
