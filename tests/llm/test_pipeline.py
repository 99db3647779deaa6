"""The pipeline against plain Python over the smallest tables."""

import pytest

import corpus_pipeline
from quadrat.llm import pii
from quadrat.llm.packing import CAPACITY, WordIds
from quadrat.llm.queries import PII_KEY

from . import reference as R

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = corpus_pipeline.run(spark, SF).toPandas()

    def kept(t):
        n, chars, symbols, lines, dup, repeat = R.quality(t)
        return not (n < 10 or 100 * repeat > 20 * n or 2 * symbols > n or (lines >= 4 and 2 * dup > lines) or chars < 2 * n or chars > 25 * n)

    left = {i: t for i, t in rows.items() if kept(t)}
    comp, _ = R.components(list(left.items()))
    left = {i: t for i, t in left.items() if comp[i] == i}
    con = R.contamination(list(left.items()), items)
    left = {i: t for i, t in left.items() if not (con[i][1] and 20 * con[i][1] >= con[i][0])}
    assert set(got.doc_id) == set(left)

    cipher, ids = pii.Cipher(PII_KEY.encode()), WordIds("word_bpe_49k.json")
    lengths = {i: len(ids.of(pii.rewrite(cipher, t)[0])) // 4 + 1 for i, t in left.items()}
    assert got.groupby("doc_id")["length"].sum().to_dict() == lengths
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *g.length.cumsum()[:-1]] and g.length.sum() <= CAPACITY


@pytest.mark.parametrize("at", range(4))
def test_columns_stay(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert corpus_pipeline.STAGES[at][1](spark, docs, SF).columns == docs.columns


@pytest.mark.parametrize("at", range(5))
def test_nothing(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[at][1](spark, docs, SF).count() == 0


@pytest.mark.parametrize("at", range(5))
def test_odd_rows(spark, at):
    """Null ids and texts, repeated rows, names that the operators use inside."""
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(None, text, "en", "s", 1), (None, None, None, None, None), (5, text + " more", "en", "s", 1), (5, text + " more", "en", "s", 1), (7, "", "en", "s", 0), (8, "mail a.b7@mail8.example.com " + text[::-1], "en", "s", 3)]
    names = ["n_email", "n_private", "n_words", "kept", "row", "name", "id", "address", "key", "failed", "piece"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"'own' AS {c}" for c in names])
    got = corpus_pipeline.STAGES[at][1](spark, docs, SF)
    if at < 4:
        assert got.columns == docs.columns and {r[c] for r in got.collect() for c in names} == {"own"}
    assert got.count() == [4, 4, 6, 6, 6][at]  # the texts of no id and of 5 are near copies
