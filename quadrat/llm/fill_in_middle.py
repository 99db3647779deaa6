r"""Fill-in-the-middle by repeated-capture matching.

A text is matched once, as ``(unit)*`` with the ``regex`` library, which keeps
every repetition of a group: ``match.ends(1)`` is the end of each unit.  So its
length is n and both cuts are looked up in it; nothing steps through the text.
Where the cuts fall, and which form a document gets, follows from the digest of
``seed:key`` alone, so it is the same on every cluster and in every attempt.

Forms: ``plain`` (the text), ``psm`` (prefix, suffix, middle) and ``spm`` (suffix,
prefix, middle), each part behind its sentinel.  ``restore`` needs only output
and form: no part holds a sentinel, and none arises where a part meets one.

Only text and two numbers go to Python, three numbers come back; outputs are
cut and joined by SQL functions.  Nothing is shuffled.

Defined results
- null text: the empty text, n = 0, plain
- a text with one of the sentinels in it stays plain
- a text that isn't a sequence of units stays plain, with n null (no text for code points)
- null key: the digest of ``seed:``; equal keys get equal draws; repeated rows a result row each
- very long texts are matched whole: about 100 bytes of memory for each unit of one text
- empty table: empty result; columns other than key and text are not carried
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point.
CODE_POINT = r"(?s:.)"
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are cut, and of 100 that are cut so many become spm.
CUT, SPM = 90, 20
#: Hexadecimal digits of one drawn number.
DIGITS = 8


def cuts(unit: str = CODE_POINT):
    """A column function of (text, a, b): n and the ends, in code points, of the units at which draws ``a`` and ``b`` cut."""
    whole = regex.compile(f"({unit})*")

    def cut(text: str, a: int, b: int) -> tuple[int | None, int | None, int | None]:
        if (m := whole.fullmatch(text)) is None:
            return None, None, None
        ends = m.ends(1)
        n = len(ends)
        first, second = sorted((a % (n + 1), b % (n + 1)))
        return n, ends[first - 1] if first else 0, ends[second - 1] if second else 0

    @F.pandas_udf("n long, first long, second long")
    def of(text: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [cut(*row) for row in zip(text, a.tolist(), b.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["n", "first", "second"], dtype="Int64")

    return of


def draw(key: Column, seed: str, i: int) -> Column:
    """The i-th number, from 0, of the digest of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1 + DIGITS * i, DIGITS), 16, 10).cast("long")


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1", unit: str = CODE_POINT, cut: int = CUT, spm: int = SPM, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars, output for each row of ``docs``; the two lengths are null where the form is plain."""
    pre, suf, mid = map(F.lit, sentinels)
    d = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    d = d.withColumn("at", cuts(unit)("text", draw(F.col("key"), seed, 0), draw(F.col("key"), seed, 1)))
    t, first, second = F.col("text"), F.col("at.first").cast("int"), F.col("at.second").cast("int")
    plain = (t == "") | F.col("at.n").isNull() | (draw(F.col("key"), seed, 2) % 100 >= cut)
    for s in sentinels:
        plain = plain | F.contains(t, F.lit(s))
    form = F.when(plain, "plain").when(draw(F.col("key"), seed, 3) % 100 < spm, "spm").otherwise("psm")
    d = d.withColumn("form", form)
    prefix, middle, suffix = F.substring(t, F.lit(1), first), F.substring(t, first + 1, second - first), F.substring(t, second + 1, F.length(t))
    output = F.when(F.col("form") == "plain", t).when(F.col("form") == "spm", F.concat(suf, suffix, pre, prefix, mid, middle)).otherwise(F.concat(pre, prefix, suf, suffix, mid, middle))
    cut_only = lambda c: F.when(F.col("form") != "plain", c)
    return d.select("key", F.col("at.n").alias("n"), "form", cut_only(F.col("at.first")).alias("prefix_chars"), cut_only(F.col("at.second") - F.col("at.first")).alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text from output and form."""
    pre, suf, mid = sentinels

    def between(a: str, b: str | None) -> Column:
        rest = F.split_part(output, F.lit(a), F.lit(2))
        return rest if b is None else F.split_part(rest, F.lit(b), F.lit(1))

    psm = F.concat(between(pre, suf), between(mid, None), between(suf, mid))
    spm = F.concat(between(pre, mid), between(mid, None), between(suf, pre))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
