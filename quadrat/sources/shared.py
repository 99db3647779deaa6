"""The folder that driver and executors share, for queries that iterate or stream."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quadrat-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark deletes the shuffle files of a query when it ends; it looks when a DataFrame is made.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder; the shuffle files that it took are gone then, not only when the driver collects its garbage."""
    conf = df.sparkSession.conf
    folder(df.sparkSession)
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
