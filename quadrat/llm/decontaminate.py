"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of 13 consecutive words (a shorter item is
one window).  A window is a set of shingles with places; to hold the window, a
document must hold all of them, so a prefix of one shingle is enough to join on.
Shingles are ordered by rarity over all documents and the rarest of each window
is its prefix: very frequent phrases are never joined on unless a window has
nothing else.  A candidate must fit between the ends of the document (length and
positional bounds) and is then verified exactly: shingles that cover the window
must stand at their places.

The scan keeps, for each document, only places of shingles that occur in some
item.  Item shingles go to the tasks in blocks of at most BLOCK, one scan each,
so what is sent to a task is bounded for any benchmark.

Defined results
- null or empty text: no words, no hit, not contaminated
- items without words give no window; repeated items count one by one by id
- an item id that is null counts as the empty string
- repeated documents (also equal or null ids) get a row each
- empty documents or benchmark: empty result, or no hits
- columns other than id and text are not carried
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import stored
from quadrat.llm.words import ALNUM_SPLIT, groups, shingles, word_hashes

WINDOW, SHINGLE = 13, 4
#: Item shingles sent to the tasks at once: 8 MB.
BLOCK = 1_000_000
#: Parts that the places of one shingle are joined in.
PARTS = 8


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, window number, length, k and the shingles of each window in order."""
    for b in batches:
        ids, rows = b.column("id").to_pylist(), []
        hashes, first = word_hashes(_texts(b, "text"), ALNUM_SPLIT)
        for i, item in enumerate(ids):
            words = hashes[first[i] : first[i + 1]]
            m = min(WINDOW, len(words))
            k = min(SHINGLE, m)
            if m:
                s = shingles(words, k).view(np.int64)
                rows += [(item, m, k, s[j : j + m - k + 1].tolist()) for j in range(len(words) - m + 1)]
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], ["item", "m", "k", "sids"])


def windows(items: DataFrame, key: str, text: str) -> DataFrame:
    """All windows of the items: item, m, k, sids, wid."""
    i = items.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text"))
    w = i.mapInArrow(_item_windows, "item string, m int, k int, sids array<long>").dropDuplicates()
    return w.withColumn("wid", F.xxhash64("m", "sids"))


def _finder(known: dict[int, np.ndarray]):
    """A scan that finds the known shingles: k -> sorted hashes."""
    bits = 22
    maps = {}
    for k, s in known.items():
        maps[k] = np.zeros(1 << bits, bool)
        maps[k][(s & np.uint64((1 << bits) - 1)).astype(np.int64)] = True

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = _texts(b, "text")
            for lo, hi in groups([len(t) for t in texts]):
                hashes, first = word_hashes(texts[lo:hi], ALNUM_SPLIT)
                place, sid, size = [], [], []
                for k, s in known.items():
                    h = shingles(hashes, k)
                    at = np.flatnonzero(maps[k][(h & np.uint64((1 << bits) - 1)).astype(np.int64)])
                    near = np.minimum(np.searchsorted(s, h[at]), len(s) - 1)
                    at = at[s[near] == h[at]]
                    doc = np.searchsorted(first, at, side="right") - 1
                    at = at[at + k <= first[doc + 1]]  # not across the end of a text
                    place.append(at)
                    sid.append(h[at].view(np.int64))
                    size.append(np.full(len(at), k, np.int32))
                at, sid, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (place, sid, size))
                order = np.argsort(at, kind="stable")
                at, sid, size = at[order], sid[order], size[order]
                cut = np.searchsorted(at, first).astype(np.int32)
                doc = np.searchsorted(first, at, side="right") - 1
                hits = pa.StructArray.from_arrays([pa.array((at - first[doc]).astype(np.int32)), pa.array(sid)], ["pos", "sid"])
                yield pa.RecordBatch.from_arrays([b.column("id").slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cut), hits)], ["id", "n_words", "hits"])

    return scan


def hits(docs: DataFrame, wins: DataFrame, key: str, text: str) -> DataFrame:
    """row, id, n_words and the (pos, sid) of shingles that some item has."""
    name = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("address"))  # ids may repeat
    d = docs.select(name.alias("id"), F.col(f"`{text}`").alias("text"))
    kind = d.schema["id"].dataType.simpleString()
    known = wins.select("k", F.explode("sids").alias("sid")).distinct()
    n_blocks = max(1, -(-known.count() // BLOCK))
    out = None
    for block in range(n_blocks):
        part = known.where(F.pmod(F.xxhash64("sid"), F.lit(n_blocks)) == block).toPandas()  # about BLOCK rows
        by_k = {int(k): np.sort(g["sid"].to_numpy(np.int64).view(np.uint64)) for k, g in part.groupby("k")}
        found = d.mapInArrow(_finder(by_k), f"id {kind}, n_words long, hits array<struct<pos:int,sid:long>>")
        found = found.withColumn("block", F.lit(block))
        out = found if out is None else out.unionByName(found)
    # the number of a row in its file names it from here on, whatever its id
    return stored(out.withColumn("row", F.monotonically_increasing_id()), "decontaminate-hits") if n_blocks == 1 else _by_document(stored(out, "decontaminate-hits"))


def _by_document(found: DataFrame) -> DataFrame:
    """The blocks of a document put together; documents with equal id and text are alike."""
    g = found.groupBy("id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.max("block").alias("_b"), F.count("*").alias("_n"))
    copies = F.explode(F.sequence(F.lit(1), (F.col("_n") / (F.col("_b") + 1)).cast("int")))
    return stored(g.withColumn("_c", copies).select("id", "n_words", F.array_sort(F.array_distinct("hits")).alias("hits"), F.monotonically_increasing_id().alias("row")), "decontaminate-blocks")


def _cover() -> Column:
    """Places within a window whose shingles cover all of its words."""
    last = F.col("m") - F.col("k")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.col("k")), F.array(last)))


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a document: id, address (hash of the text), n_words, spans (start, end in words, merged on reading), items (sorted), n_hit."""
    wins = stored(windows(items, item_key, item_text), "decontaminate-windows")
    h = hits(docs, wins, key, text)
    each = h.select("row", F.explode("hits").alias("x")).select("row", "x.pos", "x.sid")
    rarity = h.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["sid"]))).alias("sid")).groupBy("sid").agg(F.count("*").alias("docs"))
    # a window with a shingle that no document has occurs nowhere and drops out
    w = wins.select("wid", "m", "k", "sids").dropDuplicates(["wid"])
    ranked = w.select("wid", "m", "k", "sids", F.posexplode("sids").alias("at", "sid")).join(rarity, "sid")
    prefix = ranked.groupBy("wid").agg(F.min(F.struct("docs", "at", "sid")).alias("rare"), F.count("*").alias("n"), F.first("m").alias("m"), F.first("k").alias("k"), F.first("sids").alias("sids"))
    prefix = prefix.where(F.col("n") == F.size("sids")).select("wid", "m", F.col("rare.sid").alias("sid"), F.col("rare.at").alias("at"), F.transform(_cover(), lambda o: F.struct(o.alias("o"), F.get("sids", o).alias("s"))).alias("cover"))
    lengths = h.where("size(hits) > 0").select("row", "n_words")
    # a common word as a whole item meets all its occurrences: they are dealt to parts, the few prefixes go to each
    parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    dealt = each.withColumn("part", F.pmod(F.xxhash64("row", "pos"), F.lit(PARTS)).cast("int"))
    cand = dealt.join(prefix.withColumn("part", parts), ["sid", "part"]).select("row", "wid", "m", "cover", (F.col("pos") - F.col("at")).alias("start")).where("start >= 0")
    cand = cand.join(lengths, "row").where(F.col("start") + F.col("m") <= F.col("n_words"))
    needed = cand.select("row", "wid", "m", "start", F.size("cover").alias("need"), F.explode("cover").alias("c")).select("row", "wid", "m", "start", "need", (F.col("start") + F.col("c.o")).alias("pos"), F.col("c.s").alias("sid"))
    held = needed.join(each, ["row", "pos", "sid"]).groupBy("row", "wid", "start").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("m").alias("m")).where("n = need")
    named = wins.select("wid", "item").distinct()
    spans = held.join(named, "wid").groupBy("row").agg(F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("m")).alias("end")))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n"), F.greatest(a["to"], s["end"].cast("long")).alias("to")), lambda a: a["n"])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = h.select("row", "id", "n_words").join(spans, "row", "left")
    return out.select("id.id", "id.address", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(covered, F.lit(0)).alias("n_hit"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    A row is named by its id and a hash of its text, so ids may repeat or be null.
    """
    name = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("address"))
    found = contamination(docs, items, key, text)
    bad = found.where(verdict()).select(F.col("id").alias("bad_id"), F.col("address").alias("bad_address")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    kept = row.join(bad, F.col("name.id").eqNullSafe(F.col("bad_id")) & (F.col("name.address") == F.col("bad_address")), "left_anti")
    return kept.select("row.*")


def verdict() -> Column:
    """The contamination rule: some hit, and at least a twentieth of the words."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
