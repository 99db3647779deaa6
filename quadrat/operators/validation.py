"""Data checks.  Each returns its violations; an empty result is a pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rows: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """(key, code) for each rule that a row breaks."""
    codes = F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules.items()]))
    return rows.select(key, F.explode(codes).alias("code"))


def repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys of one side that the other lacks, and which side lacks them."""
    a = left.select(*key).join(right.select(*key), list(key), "left_anti").withColumn("missing_in", F.lit("right"))
    return a.unionByName(right.select(*key).join(left.select(*key), list(key), "left_anti").withColumn("missing_in", F.lit("left")))


def reasons(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Joined, sorted reasons of each key over several violation tables (key, code)."""
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reasons"))


def differences(new: DataFrame, old: DataFrame, keys: Sequence[str], value: str, tolerance: float = 1e-10) -> DataFrame:
    """Keys whose values differ by more than the tolerance, absolute and relative, or that one side lacks."""
    j = new.select(*keys, F.col(value).alias("new")).join(old.select(*keys, F.col(value).alias("old")), list(keys), "full_outer")
    same = (F.col("new").isNull() & F.col("old").isNull()) | F.coalesce(F.abs(F.col("new") - F.col("old")) <= tolerance + tolerance * F.abs("old"), F.lit(False))
    return j.where(~same)


def table_fingerprint(rows: DataFrame) -> DataFrame:
    """Count and an order-free sum of row hashes."""
    return rows.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def freeze_compare(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """One row: whether the fingerprint of ``now`` is the frozen one."""
    f = table_fingerprint(frozen).toDF("rows_then", "hash_then")
    return f.crossJoin(table_fingerprint(now)).withColumn("same", (F.col("rows_then") == F.col("rows")) & (F.col("hash_then") == F.col("hash_sum")))  # one row each


def manifest_diff(manifest: DataFrame, now: DataFrame) -> DataFrame:
    """(name, status) of each file of a manifest (name, length, rows, hash_sum): missing, mismatched or valid."""
    same = F.lit(True)
    for c in ("length", "rows", "hash_sum"):
        same = same & (F.col(f"m.{c}") == F.col(f"n.{c}"))
    j = manifest.alias("m").join(now.alias("n"), F.col("m.name") == F.col("n.name"), "left")
    return j.select("m.name", F.when(F.col("n.name").isNull(), "missing").when(same, "valid").otherwise("mismatched").alias("status"))


def selection_issues(picked: DataFrame, budget: int) -> DataFrame:
    """(class_name, code, n): classes with more than ``budget`` rows, and rows that are there again."""
    n = picked.groupBy("class_name", "sample_id").agg(F.count("*").alias("c")).groupBy("class_name").agg(F.sum("c").alias("rows"), F.sum(F.col("c") - 1).alias("again"))
    code = F.array(F.struct(F.lit("over_budget").alias("code"), F.when(F.col("rows") > budget, F.col("rows")).alias("n")), F.struct(F.lit("repeated").alias("code"), F.when(F.col("again") > 0, F.col("again")).alias("n")))
    return n.select("class_name", F.inline(code)).where("n is not null")
