"""MinHash near-deduplication by a multi-index Hamming join.

A document's set is its distinct shingles of five words.  Documents are linked
if the Jaccard similarity of their sets is at least THRESHOLD.

1. Documents with equal sets are one node: a fingerprint of the set is grouped
   first, so a group of copies, however large, is one node from here on.
2. A node's signature has CHUNKS x SYMBOLS min-hashes of 16 bits.  Split into
   chunks, two signatures that differ in fewer than CHUNKS x (ERRORS + 1) places
   have a chunk with at most ERRORS differences (pigeonhole).  For each chunk the
   allowed errors are enumerated by leaving out every choice of ERRORS symbols;
   nodes that agree on the rest meet in a bucket.  No pair under that distance is
   lost, and a pair at the threshold lies above it, or misses all chunks, with
   probability under 1e-6.
3. First round: each node is tried against the first node of the bucket that it
   shares most often.  Links are confirmed on the full sets, not the signatures.
4. Second round: only buckets whose members still lie in different components
   matter.  Members of different components whose signatures differ in at most
   REACH places are joined to clusters by a spanning set of edges; each cluster is
   compared on the full sets in tiles of two blocks, which emit a spanning set of
   their links.  No component is torn and no list of all pairs is made.
5. Components of the confirmed links, by star steps in Spark.

Defined results
- fewer than five words: the whole sequence is the one shingle
- null text or no word: empty set, linked with nothing, kept
- repeated rows: alike like any copies; ids may repeat or be null (a null id is
  kept only if no other id is in its component)
- empty table: empty result; other columns are not carried
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import slices, stored
from quadrat.llm.components import roots
from quadrat.llm.words import BLANK_SPLIT, groups, mix, shingles, word_hashes

K = 5
#: Percent of the union that the intersection must reach.
THRESHOLD = 75
CHUNKS, SYMBOLS, ERRORS = 12, 4, 1
#: Differing places beyond which a pair isn't tried on the full sets; at the threshold fewer than 1e-6 of pairs lie beyond.
REACH = 29
#: Bytes of the comparison table of one step within a bucket.
TABLE = 16_000_000
#: Members beyond which a bucket isn't compared by signatures first; nodes and characters in a block of a tile, about.
LARGE, TILE, TILE_CHARS = 1000, 2000, 16_000_000
#: Pairs that are confirmed in one group, and characters of their texts, about.
PAIRS, PAIR_CHARS = 20_000, 32_000_000

_seeds = mix(np.arange(1, CHUNKS * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_variants = [tuple(i for i in range(SYMBOLS) if i not in out) for out in combinations(range(SYMBOLS), ERRORS)]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, first = word_hashes(texts, BLANK_SPLIT)
    out = []
    for i in range(len(texts)):
        words = hashes[first[i] : first[i + 1]]
        out.append(np.unique(shingles(words, min(K, len(words)))) if len(words) else np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit min-hashes for each set; zeros for an empty one."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), len(_seeds)), "<u2")
    full = np.flatnonzero(sizes)
    if len(full):
        joined = np.concatenate([sets[i] for i in full])
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        for j, seed in enumerate(_seeds):
            h = joined * seed
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            low = np.minimum.reduceat(h, starts)
            out[full, j] = (low >> np.uint64(48)).astype("<u2") ^ (low >> np.uint64(20)).astype("<u2")
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("text").cast(pa.binary())
        for lo, hi in groups(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            sets = shingle_sets([t or b"" for t in column.slice(lo, hi - lo).to_pylist()])
            sig = signatures(sets)
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("id").slice(lo, hi - lo), b.column("address").slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([row.tobytes() for row in sig], pa.binary())],
                ["id", "address", "n_shingles", "print", "sig"],
            )


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key for each chunk and each way to leave out ERRORS symbols of it."""
    wide = sig.astype(np.uint64).reshape(len(sig), CHUNKS, SYMBOLS)
    keys = []
    for v, kept in enumerate(_variants):
        h = np.full((len(sig), CHUNKS), v + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(CHUNKS, dtype=np.uint64)
        for i in kept:
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + wide[:, :, i])
        keys.append(h)
    return np.concatenate(keys, axis=1).view(np.int64)


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            part = b.slice(at, 4096)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u2").reshape(part.num_rows, -1)
            keys = bucket_keys(sig)
            nodes = np.repeat(part.column("node").to_numpy(zero_copy_only=False), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (node, smaller node) that join what lies within REACH across components in a bucket; a spanning set, not all pairs.

    The rows come sorted by key and node, so a group's edges lead to its smallest
    node, and the buckets of one group repeat the same few edges.
    """

    def edges(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        node, comp = t["node"].to_numpy(), t["comp"].to_numpy()
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), "<u2").reshape(len(node), -1)
        label, met = np.arange(len(node)), np.zeros(len(node), bool)
        step = max(1, TABLE // (2 * sig.shape[1] * len(node)))
        for at in range(0, len(node) - 1, step):
            far = np.zeros((min(step, len(node) - at), len(node) - at), np.int16)
            for j in range(sig.shape[1]):
                far += sig[at : at + step, None, j] != sig[None, at:, j]
            close = (far <= REACH) & (comp[at : at + step, None] != comp[None, at:])
            for i in np.flatnonzero(close.any(axis=1)):
                group = np.append(at + np.flatnonzero(close[i]), at + i)
                met[group] = True
                old = np.unique(label[group])
                if len(old) > 1:
                    label[np.isin(label, old)] = old[0]
        at = np.flatnonzero(met)
        return pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(node[label[at]])], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        key = b.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            part = b.slice(lo, hi - lo)
            if held and held[0].column("key")[0] != part.column("key")[0]:
                yield edges(held)
                held = []
            held.append(part)
    if held:
        yield edges(held)


def _tile(unit: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that join the components of a tile, a spanning set of all its links; exact, by an index of the shingles."""
    sets = shingle_sets([t.encode("utf-8", "surrogatepass") for t in unit["text"]])
    size = np.array([len(x) for x in sets])
    node, comp, block = (unit[c].to_numpy() for c in ("node", "comp", "block"))
    left, right = (np.flatnonzero(block == x) for x in (block.min(), block.max()))
    words, post = np.unique(np.concatenate([sets[i] for i in right]), return_inverse=True)
    order = np.argsort(post, kind="stable")
    holder = np.repeat(np.arange(len(right)), size[right])[order]
    first = np.searchsorted(post[order], np.arange(len(words) + 1))
    above: dict[int, int] = {}

    def top(c: int) -> int:
        while (up := above.get(c, c)) != c:
            above[c] = c = above.get(up, up)
        return c

    out = []
    for i in left:
        at = np.minimum(np.searchsorted(words, sets[i]), len(words) - 1)
        at = at[words[at] == sets[i]]
        n = first[at + 1] - first[at]
        slots = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holder[slots], minlength=len(right))
        for k in np.flatnonzero((100 * both >= THRESHOLD * (size[i] + size[right] - both)) & (comp[right] != comp[i])):
            j = right[k]
            x, y = top(int(comp[i])), top(int(comp[j]))
            if x != y:
                above[max(x, y)] = min(x, y)
                out.append((int(node[i]), int(node[j])))
    return out


def _tiles(unit: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(_tile(unit), columns=["a", "b"], dtype="int64")


def _across_clusters(near: DataFrame, comps: DataFrame, texts: DataFrame) -> DataFrame:
    """All links between different components of nodes that ``near`` joins.

    A cluster of near nodes is cut into blocks of about TILE nodes and TILE_CHARS
    characters and compared block by block: a group in pandas is one tile of two
    blocks, and no pair is a row.  A text is a row for each block of its cluster,
    so a cluster of N nodes makes N * N / TILE rows, spread over its tiles.
    """
    n = slices(near.sparkSession)
    members = roots(near).select("node", F.col("root").alias("cluster"))
    members = stored(members.join(texts.select("node", "chars"), "node"), "near-dedup-clusters")
    wanted = F.greatest(F.count("*") / TILE, F.sum("chars") / TILE_CHARS)
    blocks = members.groupBy("cluster").agg(F.ceil(wanted).cast("int").alias("blocks"))
    m = members.select("node", "cluster").join(blocks, "cluster").join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    m = m.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block")
    # a stated number of partitions: a tile is little to read and much to compute, so few bytes mustn't mean few tasks
    return m.join(texts.drop("chars"), "node").repartition(n, "cluster", "i", "j").groupBy("cluster", "i", "j").applyInPandas(_tiles, "a long, b long")


def _confirm(key: tuple, pairs: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
    sets = dict(zip(texts["node"], shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts["text"]]), strict=True))
    good = []
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        x, y = sets[a], sets[b]
        both = 0
        if 100 * min(len(x), len(y)) >= THRESHOLD * max(len(x), len(y)):
            both = len(np.intersect1d(x, y, assume_unique=True))
        good.append(100 * both >= THRESHOLD * (len(x) + len(y) - both))
    return pairs.loc[good, ["a", "b"]]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar.

    Pairs are dealt to parts of about PAIRS pairs and PAIR_CHARS characters at
    most by their first node and a salt, so one node with very many partners is
    spread; a part gets each text that it needs once.
    """
    pairs = stored(pairs, "near-dedup-pairs")
    uses = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    held = uses.join(texts.select("node", "chars"), "node").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("chars")), F.lit(0))).first()
    n = max(8 * slices(pairs.sparkSession), -(-held[0] // (2 * PAIRS)), -(-held[1] // PAIR_CHARS))
    salt = F.pmod(F.xxhash64("b"), F.lit(max(16, n // 8)))
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("a", salt), F.lit(n)).cast("int"))
    needed = dealt.select("part", F.explode(F.array("a", "b")).alias("node")).distinct()
    with_text = needed.join(texts, "node").select(F.col("part").alias("text_part"), "node", "text")
    return dealt.groupBy("part").cogroup(with_text.groupBy("text_part")).applyInPandas(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, address (hash of the text), n_shingles, component_id (smallest id of the component), node, kept (one row of each component)."""
    d = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    d = d.withColumn("address", F.xxhash64("text"))
    kind = d.schema["id"].dataType.simpleString()
    rows = d.mapInArrow(_describe, f"id {kind}, address long, n_shingles long, print binary, sig binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "near-dedup-rows")

    full = rows.where("print is not null")
    # one row for each set: the address of a text that has it, to find that text again
    nodes = full.groupBy("print").agg(F.min("row").alias("node"), F.min(F.struct("id", "address")).alias("at"), F.first("sig").alias("sig"))
    nodes = stored(nodes, "near-dedup-nodes")

    keys = nodes.select("node", "sig").mapInArrow(_enumerate, "key long, node long")
    # minimum, count and maximum are pre-aggregated: a bucket with very many members costs a row for each task
    pivots = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1").select("key", "pivot")
    shared = stored(keys.join(pivots, "key"), "near-dedup-buckets")

    star = shared.where("node != pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    first = star.groupBy("node").agg(F.max(F.struct("n", F.negative("pivot").alias("p"))).alias("best")).select(F.negative("best.p").alias("a"), F.col("node").alias("b"))
    wanted = shared.select("node").distinct().join(nodes.select("node", "at.id", "at.address"), "node")
    texts = d.select("id", "address", "text").alias("t").join(wanted.alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")) & (F.col("t.address") == F.col("w.address"))).select("w.node", "t.text", F.length("t.text").cast("long").alias("chars"))
    texts = stored(texts, "near-dedup-texts")

    links = stored(confirmed(first, texts), "near-dedup-links")
    comps = roots(links)
    placed = shared.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("root", "node").alias("comp"))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"), F.min("node").alias("least")).where("low != high").select("key", "size", "least")
    rest = placed.join(open_, "key")
    # a bucket too large to compare in one task counts as near throughout
    large = rest.where(F.col("size") > LARGE).select(F.col("node").alias("a"), F.col("least").alias("b"))
    small = rest.where(F.col("size") <= LARGE).select("key", "node", "comp").join(nodes.select("node", "sig"), "node")
    near = small.repartition(slices(docs.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(_near, "a long, b long").unionByName(large)
    more = stored(_across_clusters(near, comps, texts), "near-dedup-links")
    if not more.isEmpty():
        comps = roots(links.unionByName(more))

    of_print = nodes.select("print", "node").join(comps, "node", "left").select("print", F.coalesce("root", "node").alias("node"))
    placed_rows = rows.join(of_print, "print", "left").select("id", "address", "row", "n_shingles", F.coalesce("node", "row").alias("node"))
    smallest = placed_rows.groupBy("node").agg(F.min("id").alias("component_id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    # stored, so that both sides of the join come from a shuffle and the rows of one very large component can be split
    out = placed_rows.join(stored(smallest, "near-dedup-smallest"), "node")
    return out.select("id", "address", "n_shingles", "component_id", "node", (F.col("row") == F.col("first.row")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their columns.

    A row is named by its id and a hash of its text; of rows equal in both the
    one whose columns come first as JSON stays.
    """
    found = near_duplicates(docs, key, text).groupBy(F.col("id").alias("kept_id"), F.col("address").alias("kept_address"))
    kept = stored(found.agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("kept"), "near-dedup-kept")
    name = F.struct(F.col(f"`{key}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("address"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), name.alias("name"))
    same = F.col("name.id").eqNullSafe(F.col("kept_id")) & (F.col("name.address") == F.col("kept_address"))
    single = row.join(kept.where("n = 1"), same, "left_semi").select("row")
    repeated = row.join(kept.where("n > 1"), same, "left_semi").groupBy("name").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(repeated).select("row.*")
