"""The corpus pipeline: quality rules, near-dedup, decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept
and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage's result to the shared folder before the next begins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, near_dedup, packing, pii, quality_rules
from quadrat.llm.common import release, stored, table, written
from quadrat.llm.queries import PII_KEY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the standard policy of the rule ledger keeps."""
    return quality_rules.keep(docs, quality_rules.STANDARD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the text; n_chars follows the text."""
    done = pii.pseudonymise(docs, PII_KEY, counted=False)
    return done.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it."""
    packed, _ = packing.pack(docs)
    return packed.select(F.col("key").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", pack)]

#: Keyed pseudonyms and the packing can't be said in SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), written()
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
            release(spark, keep=docs, before=before)  # the stage is written: what it stored on its way isn't needed any more
    return docs
