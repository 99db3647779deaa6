"""Secret scans with an incremental blob ledger.

Every version of every file is content-addressed (sha256 of its text).  A ledger
holds the (blob, rule version) pairs that were scanned and what was found; only
pairs it lacks are scanned, each blob once however many paths and versions hold
it, and the findings are joined back to all paths.

Base kinds, leftmost and non-overlapping for each kind: ``assign``, ``access``
and ``hex``.  Further kinds (FORMATS) add spans and never remove one.

A blob is scanned where one of its rows is: the row of its smallest place, a hash
of the path.  Rows that share path and blob have one place and one text, so no
choice among them matters.  Only blobs that were scanned become ledger entries.

Defined results
- null text: the empty blob, no finding; a null path is a path
- equal texts share one scan (rows that repeat path and blob at most one for each task that meets them)
- repeated rows get a result row each
- very long texts are scanned whole
- empty table: empty results; ledger ``None`` or empty: everything is unseen
- columns other than the path and the text are not carried
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import hot_parts, stored

RULE_VERSION = "base-1+formats-2"
KINDS = ("assign", "access", "hex")
#: Places that a task remembers so as not to pass on a repeated row.
REMEMBERED = 1 << 18
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {SPANS}"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, so the same as runs of any length of which the short ones are dropped
#: kind -> (string that a match must hold, pattern)
FORMATS: dict[str, tuple[str, re.Pattern]] = {
    "private_key": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")),
    "code_host_token": ("gh", re.compile(r"(?a)\bgh[opsur]_[A-Za-z0-9]{36,}")),
    "chat_token": ("xox", re.compile(r"(?a)\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "web_token": ("eyJ", re.compile(r"(?a)\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by start, then by kind as listed; code points."""
    if not text:
        return []
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for k, (holds, pattern) in enumerate(FORMATS.values(), len(KINDS)):
        if holds in text:
            found += [(m.start(), k, m.end()) for m in pattern.finditer(text)]
    names = (*KINDS, *FORMATS)
    return [(names[k], a, b) for a, k, b in sorted(found)]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"blob": b["blob"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in b["text"]]})


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those that repeat (place, blob), as far as the task remembers."""
    seen: set[tuple[int, bytes]] = set()
    for b in batches:
        names = list(zip(b.column("place").to_pylist(), map(bytes.fromhex, b.column("blob").to_pylist()), strict=True))
        at = []
        for i, name in enumerate(names):
            if name not in seen:
                at.append(i)
                seen.add(name)
        if len(seen) > REMEMBERED:  # a row more is scanned twice, none is lost
            seen = set(names[-1:])
        yield b.take(pa.array(at, pa.int64()))


def blobs(versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, blob, text of each row; a null text is the empty one."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return versions.select(F.col(f"`{path}`").alias("path"), F.sha2(t, 256).alias("blob"), t.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, path: str = "path", text: str = "text", rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(rows, entries): path, blob, spans for each row of ``versions``; the new ledger entries.

    The first pass reads the texts only to address them; its shuffle holds one
    key for each blob and task.  The second moves each text once to meet the
    list of unseen blobs, by path and blob, so neither the copies of one blob
    nor the versions of one path meet in one task.  What is scanned is stored
    before either result reads it.  A blob that very many rows hold is joined
    to its findings in parts.
    """
    # a hash of the path stands for it, so a null path needs no rule of its own
    all_rows = blobs(versions, path, text).withColumn("place", F.xxhash64("path"))
    held = stored(all_rows.groupBy("blob").agg(F.min("place").alias("place"), F.count("*").alias("n")), "secret-scan-blobs")
    todo = held.select("blob", "place")
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans").dropDuplicates(["blob"])
        todo = todo.join(seen.select("blob"), "blob", "left_anti")
    each = all_rows.select("place", "blob", "text").mapInArrow(_once, "place long, blob string, text string")
    scanned = each.join(todo, ["place", "blob"], "left_semi").select("blob", "text").mapInPandas(_scan, f"blob string, spans {SPANS}").dropDuplicates(["blob"])
    scanned = stored(scanned, "secret-scan-found")
    found = scanned if ledger is None else scanned.unionByName(seen)
    hot = F.broadcast(hot_parts(held, "blob"))  # bounded by its rule
    parts = found.where("size(spans) > 0").join(hot, "blob", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    rows = all_rows.select("path", "blob").join(hot, "blob", "left").withColumn("part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0)).cast("int"))
    rows = rows.drop("parts").join(parts.drop("parts"), ["blob", "part"], "left")
    rows = rows.select("path", "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))
    return rows, scanned.select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def told(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(rows: DataFrame) -> DataFrame:
    """path, counts of the base kinds, digest of the base spans, all spans."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return rows.select("path", *[of(k).alias(f"n_{k}") for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
