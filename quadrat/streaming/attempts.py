"""Structured Streaming over append-only ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The table as a stream of files; its schema is read once and then fixed."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    s = spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")
    return s.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in s.columns else s


def attempt_window(events: DataFrame, delay: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Attempts and latency for each tumbling window and backend; rows later than the watermark are dropped."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size), F.col("event_type").alias("backend")).agg(F.count("*").alias("attempts"), F.avg("value").alias("latency"))


def attempt_dedup(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Repeats of one target within the watermark collapse to the first."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def state_coverage(labels: DataFrame) -> DataFrame:
    """Running support of each state as labels arrive; update mode."""
    return labels.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


def leak_guard(targets: DataFrame, history: DataFrame, key: str) -> DataFrame:
    """New targets with ``leaked``: whether the history has their key (a stream-static join)."""
    return targets.join(history.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").withColumn("leaked", F.coalesce("_seen", F.lit(False))).drop("_seen")


def drain(stream: DataFrame, folder: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All that is there now, through the stream into a table of ``folder``, and that table.

    Update mode needs ``keys``: each batch is written whole and the last version
    of a key is read.
    """
    spark, run = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{run}/state").trigger(availableNow=True)
    if keys is None:
        w.format("parquet").option("path", f"{run}/table").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{run}/table")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{run}/table/batch={number}")

    w.foreachBatch(put).start().awaitTermination()
    rows = spark.read.parquet(f"{run}/table").drop("batch")
    value = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "_batch").alias("v")).select(*keys, "v.*")
