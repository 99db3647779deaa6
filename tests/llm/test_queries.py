"""Each registered query over the smallest tables: against its SQL in DuckDB, or against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import language_id, secret_scan
from quadrat.llm.packing import CAPACITY, WordIds, best_fit
from quadrat.llm.queries import ORACLES, QUERIES

from ..test_queries import duck, plain  # noqa: F401
from . import reference as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def hexed(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):  # noqa: F811
    got, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_op1_plain(spark):
    from quadrat.llm.queries import URL_RULES

    from .test_operators import judged

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in QUERIES["op1_url_filter"](spark, SF).collect()}
    assert got == {i: judged(u, URL_RULES) for i, u in urls.items()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op2(spark, sf):
    """By forms and check digits of the test's own: what is private is replaced one to one in its form, the rest of the text stays."""
    import re

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, f"/root/testdata/{sf}").collect()}
    assert set(got) == set(docs)
    pseudonym: dict = {}
    for i, t in docs.items():
        r, values = got[i], R.private_values(t)
        counts = {k: sum(kind == k for kind, _ in values) for k in R.PRIVATE_FORMS}
        assert {k: r[f"n_{k}"] for k in counts} == counts and r.n_private == len(values)
        # the text between the values, cut at what the test knows to be private
        at, old, new = 0, t or "", r.text or ""
        assert (t is None) == (r.text is None)
        for kind, v in values:
            k = old.index(v, at)
            assert new[at:k] == old[at:k]
            other = new[k : k + len(v)] if kind != "ip" else re.match(r"[0-9.]+[0-9]", new[k:])[0]
            if kind != "ip":  # numbers of an address may differ in width
                assert (R.shape(other) == R.shape(v)) or kind == "email"
            pseudonym.setdefault((kind, v), set()).add(other)
            old, new = old[:k] + old[k + len(v) :], new[:k] + new[k + len(other) :]
            at = k
        assert new[at:] == old[at:]
    assert len(pseudonym) > 10 and all(len(x) == 1 for x in pseudonym.values())  # equal values stay linked
    told = [(k, *x) for (k, _), x in pseudonym.items()]
    assert len(set(told)) == len(told)  # different values stay different
    for (kind, v), (other,) in pseudonym.items():
        assert other != v and (kind != "card" or R.luhn_holds(other)) and (kind != "ip" or all(int(x) < 256 for x in other.split(".")))


def test_op3(spark, texts):
    got = {r.doc_id: r for r in QUERIES["op3_secret_scan"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        base = R.base_spans(t)
        told = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == hexed(told)
        assert [got[i][f"n_{x}"] for x in secret_scan.KINDS] == [sum(k == j for _, k, _ in base) for j in range(3)]


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_op3_repeated_texts(spark, sf):
    """A table in which texts with secrets occur under several ids."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.spans for r in QUERIES["op3_secret_scan"](spark, f"/root/testdata/{sf}").collect()}
    assert got == {i: ",".join(f"{k}:{a}:{z}" for k, a, z in secret_scan.find(t)) for i, t in docs.items()}


def test_op3_in_two_rounds(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    early = docs.where("doc_id % 3 != 0")
    _, ledger = secret_scan.scan(early, path="doc_id")
    ledger = spark.createDataFrame(ledger.collect(), secret_scan.LEDGER)
    rows, new = secret_scan.scan(docs, ledger, path="doc_id")
    blob = lambda t: hexed(t or "")
    seen = {blob(t) for i, t in texts.items() if i % 3}
    assert {r.blob for r in new.collect()} == {blob(t) for t in texts.values()} - seen
    whole, _ = secret_scan.scan(docs, path="doc_id")
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, whole.collect()))


def test_op5(spark):
    known = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", (language_id.fold(F.col("doc_id")) == 2).alias("held"))
    got = QUERIES["op5_language_id"](spark, SF).join(known, "doc_id").collect()
    assert all(r.held == r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)


def test_op6(spark, texts):
    rows = QUERIES["op6_best_fit_packing"](spark, SF).collect()
    encode = WordIds("word_bpe_49k.json").tokenizer.encode
    want = set()
    for i, t in texts.items():
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k, at, len(x := ids[at : at + CAPACITY]), zlib.crc32(x.tobytes())) for k, at in enumerate(range(0, len(ids), CAPACITY))}
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
    assert max(held.values()) <= CAPACITY
    lengths: dict = {}
    for *_, n, _ in want:
        lengths[n] = lengths.get(n, 0) + 1
    assert len(held) <= sum(n for _, n in best_fit(lengths, CAPACITY))


def test_op7(spark, texts):
    flags = R.removed(list(texts.items()))
    got = {r.doc_id: r for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()}
    for i, t in texts.items():
        b, f = (t or "").encode(), flags[i]
        runs = sum(1 for k in range(len(f)) if f[k] and not (k and f[k - 1]))
        kept = bytes(c for c, x in zip(b, f, strict=True) if not x)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(f), runs, hashlib.sha256(kept).hexdigest())


def test_op9(spark, texts):
    comp, size = R.components(list(texts.items()))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op9_near_dedup"](spark, SF).collect()}
    assert got == {i: (size[i], comp[i], comp[i] == i) for i in texts}


def test_op13(spark, texts):
    rows = QUERIES["op13_tiered_packing"](spark, SF).collect()
    check_tiers(rows, texts, 2048, 1 << 16)


def check_tiers(rows, texts, longest, tokens):
    """Every id in one piece, sequences gapless and as long as a power of two, steps of one size and no more than their tokens."""
    encode = WordIds("word_bpe_49k.json").tokenizer.encode
    ids = {i: np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    at = dict.fromkeys(ids, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : at[r.doc_id]].tobytes())
    assert at == {i: len(x) for i, x in ids.items()}
    held, tier = {}, {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0) and tier.setdefault(r.sequence_id, (r.tier, r.step)) == (r.tier, r.step)
        held[r.sequence_id] = r.offset + r.length
    assert all(n == tier[s][0] and n <= longest and not n & (n - 1) for s, n in held.items())
    assert set(held) == set(range(len(held)))
    steps: dict = {}
    for s, n in held.items():
        steps.setdefault(tier[s][1], []).append((tier[s][0], n))
    assert set(steps) == set(range(len(steps)))
    assert all(len({t for t, _ in x}) == 1 and sum(n for _, n in x) <= tokens for x in steps.values())
    short = [x[0][0] for x in steps.values() if sum(n for _, n in x) < tokens]
    assert len(short) == len(set(short))  # of each size at most one step isn't full
    return [steps[k][0][0] for k in sorted(steps)]
